"""Each operator against a plain version on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeframe.llm import batches, components, decontaminate, language_id, line_dedup, mixing, near_dedup, neighbours, secret_scan, substring_dedup, token_counts, twice, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, `drop` string, n_words string, hits string, size string"
LINE = "The same line stands in many documents."
PASSAGE = " ".join(f"word{i}" for i in range(60))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts: list[str | None] = [None, "", " \n\t ", "one", "x", "é漢 Ünïcode", LINE + "\n" + prose(30), prose(20) + "\n " + LINE.upper() + "\t\n" + LINE, LINE]
    base = prose(80)
    for i in range(12):
        near = base.split(" ")
        near[i * 5] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [base, base, base.upper(), prose(3000), PASSAGE, prose(20) + " " + PASSAGE + " " + prose(20), PASSAGE + "\n" + prose(15), "ha " * 40, "ha " * 50]
    texts += [prose(rng.randint(1, 60)) for _ in range(20)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base + " tail", "en", "s1", 1), rows[9], rows[20], (3, "one", None, "s2", 3)]
    return [(*r, "a", "b", "c", "d", "e") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ident(x):
    return -(1 << 63) if x is None else x


def test_line_dedup(docs, empty):
    rows = corpus()
    key = lambda line: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders: dict[str, set[int]] = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders.setdefault(key(line), set()).add(ident(r[0]))
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == ident(r[0])]
        want.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = line_dedup.line_report(docs).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[2] for w in want) > 0
    assert line_dedup.line_report(empty).count() == 0
    cleaned = line_dedup.without_repeated_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert cleaned.filter("doc_id = 0").first().text is None


def test_twice_misses_no_repeat(spark):
    values = list(range(2000)) + list(range(0, 2000, 7))
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    hashed = lambda b: iter([batches.mix(b.column(0).to_numpy().astype(np.uint64))])
    test = twice.seen_twice(rows, hashed, len(values))()
    suspected = test(batches.mix(np.arange(2000, dtype=np.uint64)))
    assert suspected[::7].all()
    assert suspected.sum() < 286 + 100


def test_twice_bounds_the_filter(spark, monkeypatch):
    monkeypatch.setattr(twice, "MOST_CELLS", 1 << 16)
    rows = spark.createDataFrame([(v,) for v in range(5000)], "v long")
    hashed = lambda b: iter([batches.mix(b.column(0).to_numpy().astype(np.uint64))])
    assert len(twice.seen_twice(rows, hashed, 1 << 40).data.value) == 1 << 13


def targets(sizes: dict) -> dict:
    """The excess over three times a source, reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def test_mixing(docs, empty):
    rows = corpus()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for r in rows:
        sums[r[3]] += size(r[1])
    want = targets(sums)
    got = mixing.mix(docs).collect()
    assert Counter((g.doc_id, g.size) for g in got) == Counter((r[0], size(r[1])) for r in rows)
    taken = Counter()
    for g in got:
        own = sum(p.words for p in g.pieces)
        assert own <= 3 * g.size and g.source_size == sums[g.source] and abs(g.target - want[g.source]) < 1e-6
        taken[g.source] += own
        for epoch in range(3):
            parts = sorted((p.first, p.words) for p in g.pieces if p.epoch == epoch)
            assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sums)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in mixing.mix_report(docs).collect()}
    assert mixing.mix_report(empty).count() == 0
    plan = mixing.mix_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_splitting_tree_shares_blocks(spark):
    counts = [300, 0, 45, 7, 1]
    leaves = mixing.split(spark.createDataFrame([(0, counts)], "cohort long, counts array<long>"), 16, 1).collect()
    assert sorted(r.shard for r in leaves) == list(range(16))
    assert [sum(r.counts[i] for r in leaves) for i in range(5)] == counts
    sizes = [sum(r.counts) for r in leaves]
    assert max(sizes) - min(sizes) <= 1
    assert all(8 <= r.counts[0] <= 22 for r in leaves)


def test_mixed_layout_draws_each_word_as_often_as_taken(docs):
    rows = mixing.layout(docs, shards=4, blocks=40)
    laid = rows.groupBy("doc_id").sum("words").collect()
    want = Counter()
    for r in mixing.mix_report(docs, shards=4, blocks=40).collect():
        want[r.doc_id] += r.taken
    assert {r[0]: r[1] for r in laid} == {k: v for k, v in want.items() if v}
    shards = [r["sum(words)"] for r in rows.groupBy("shard").sum("words").collect()]
    assert len(shards) == 4 and max(shards) < 1.5 * min(shards)


SECRETS = [
    'password = "hunter2secret" and token:abc', "PASSWD:'x1y2z3' API_KEY=aaaaaa", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "é " + "0f" * 12 + "g" + "a" * 23,
    "secret:::nothing", "token=token=abcdef", "passphrase: 8fK!x92mQp#L0z and pwd = password123", "login: correct", "ſecret=abcdef toKen=abcdef", None, "", "x" * 200_000,
]


def test_secret_scan(spark, empty):
    got = secret_scan.secret_spans(spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")).collect()
    assert len(got) == len(SECRETS)
    any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    keys = "|".join(map(any_case, ("password", "passwd", "secret", "token"))) + "|" + any_case("api") + "_?" + any_case("key")
    assign = re.compile(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for g in got:
        text = SECRETS[g.doc_id] or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        listed = secret_scan.listed(sorted(base))
        assert g.base_sha256 == sha(listed) and set(filter(None, listed.split(","))) <= set(g.spans.split(","))
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
    spans = {g.doc_id: g.spans for g in got}
    assert spans[6] == "guess:12:26"
    assert "guess" not in spans[7]
    assert secret_scan.secret_spans(empty).count() == 0


def test_guess_cost_prefers_cheap_segments():
    cost = secret_scan.GuessCost()
    assert cost("password") < 1.5 < cost("Passw0rd!") < 5
    assert cost("qwertyuiop") < cost("q7w!e9rt#y") and cost("20240229") < 5.5 and cost("ababababab") < 4
    assert cost("x8Kd92mQpL0z") > 12 and cost("") == 0
    for value in ("password20240101", "aaa111qwe", "zxcvbZ9"):
        cuts = [cost(value[:i]) + cost(value[i:]) for i in range(1, len(value))]
        assert cost(value) <= min(cuts) + 0.61


def test_prose_is_no_secret_and_planted_values_are():
    finder = secret_scan.Finder(list(secret_scan.WORDS), 10.0, 8)
    clean = (
        "The token is responsible", "Authentication is important", "author: Shakespeare", "The secretary: Katherine", "authority is questionable", "passenger is travelling",
        "login: Administrator", "passcode: international", "secretariat = Washington", "tokens: responsible", "credentials: username2024",
    )
    for text in clean:
        assert not [f for f in finder(text.encode()) if f[1] == 3], text
    planted = (
        "passphrase: x8Kd92mQpL0z", "DB_PASSWORD=>9f!Kq2#vLw8", "auth-token2 = 'Zk3vQ8sT1bN6'", "pwd:7Gh#2kLp9Q", "private_key: MIIEvQIBADANBgkqh", "credentials = bq7xkz93wmtr",
    )
    for text in planted:
        assert [f for f in finder(text.encode()) if f[1] == 3], text


def test_guess_cost_equals_the_least_over_all_segmentations():
    """Every way to cut a short value, each piece by its cheapest single rule."""
    cost = secret_scan.GuessCost(["dog", "house"])
    rng = random.Random(9)

    def least(value):
        best = [0.0]
        for i in range(1, len(value) + 1):
            best.append(min(best[j] + (cost.brute(value[j]) if i - j == 1 else math.inf) for j in range(i)))
            for j in range(i - 1):
                best[i] = min(best[i], best[j] + single(value, j, i))
        return best[-1]

    def single(value, j, i):
        piece, low = value[j:i], value[j:i].lower()
        out = []
        for word, rank in cost.rank.items():
            upper = sum(c.isupper() for c in piece)
            case = 0.3 * min(upper, len(piece) - upper) + (0.3 if upper else 0.0)
            if low == word:
                out.append(0.3 + rank + case)
            elif low.translate(secret_scan.LEET) == word:
                out.append(0.9 + rank + case)
        for p in range(1, 5):
            times = len(piece) // p
            if times >= 3 and piece == piece[:p] * times:
                out.append(0.3 + sum(map(cost.brute, piece[:p])) + math.log10(times))
        return min(out, default=math.inf)

    for _ in range(300):
        value = "".join(rng.choice(["dog", "D0g", "house", "hoUse", "7", "#", "Q"]) for _ in range(rng.randint(1, 4)))
        assert cost(value) == pytest.approx(least(value)), value


def test_redacted_texts(spark):
    rows = spark.createDataFrame([(1, "a password = hunter2x b", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id long, text string, spans string")
    assert [r.text for r in secret_scan.redact(rows).orderBy("doc_id").collect()] == ["a [secret] b", None, "clean"]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(600, 12)).astype(np.float32)
    points[100:300] = points[100]
    rows = [(i, p.tolist(), "x") for i, p in enumerate(points)]
    rows += [(1000, None, "x"), (1100, [0.0] * 12, "x"), (1200, [float("nan")] * 12, "x"), (1300, [None] * 12, "x"), (1400, [1.0, 2.0], "x"), (None, [1.0] * 12, "x"), rows[0], rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string").repartition(4)
    got = {}
    for r in neighbours.neighbours(table, every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        distance = np.sqrt(((points.astype(float) - points[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(600), distance)) if i != q][:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(s - distance[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(map(int, order)))
    assert hits >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[100])] == list(range(101, 111))


def test_few_and_no_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (7, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in neighbours.neighbours(few).orderBy("rank").collect()] == [(1, 1), (2, 7)]
    assert neighbours.neighbours(few.filter("vec_id > 9")).count() == 0


def test_chi_square():
    assert abs(neighbours.chi_square(neighbours.quantile(0.9, 8), 8) - 0.9) < 1e-9
    assert abs(neighbours.quantile(0.95, 2) - 5.991464547) < 1e-6


URLS = [
    "http://example.org/es/1", "https://A.Example.ORG/en/123?x#y", "http://example.org", "http://notexample.org/es/", "x://com/fr/", "http://www.b.com/de/x/y?z", "http://com.de/de/",
    None, "", "no scheme/org/", "http://user@example.org:80/es/", "a://b://example.org/es/", "http:///es/", "http://example.org?/es/", "http://" + "a." * 3000 + "org/" + "p" * 9000, "http://É.org/",
]


def test_url_filter(spark, empty):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, table).collect()}
    assert len(got) == len(URLS) + 3
    for i, url in enumerate(URLS + URLS[:3]):
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0] if url and "://" in url else ""
        host, slash, tail = rest.partition("/")
        host, path = host.translate({c: c + 32 for c in range(65, 91)}), slash + tail
        fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict), url
    assert url_filter.judge(pages.filter("page_id < 0"), table).count() == 0
    assert url_filter.judge(pages, table.filter("verdict = 'x'")).filter("rule IS NULL AND verdict = 'allow'").count() == len(got)


def brute_classes(rows: list[tuple], words: int, percent: int) -> dict:
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), ident(r[0]))
    return Counter((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_dedup(docs, empty, words, percent, monkeypatch):
    got = Counter((r.doc_id, r.n_shingles, ident(r.component_id)) for r in near_dedup.near_report(docs, words, percent).collect())
    assert got == brute_classes(corpus(), words, percent)
    assert near_dedup.near_report(empty).count() == 0


def test_near_clusters_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3, " ".join(words)))
    found = near_dedup.near_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows, 3, 85)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    assert 1 < len({c for _, _, c in want}) < 90


def test_one_document_of_each_group_stays(docs):
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    report = near_dedup.near_report(docs, 5, 80)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in report.filter("kept").collect()}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    alphabet = "aaaabcdethenst  ing\n\t'sdlrve0123.,$é漢\u200b\x1c\x85\xa0\u3000ÈÀ😀"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.choice((3, 10, 60)))) + rng.choice(("", "<|endoftext|>", " " * 20, "a" * 80)) for _ in range(300)]
    rows = [(r[0], r[1]) for r in corpus()] + [(1000 + i, t) for i, t in enumerate(odd)] + [(1, odd[0] * 40), (1, odd[0] * 40), (2, "a" * 500), (3, " " * 500)]
    want = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, token_counts.token_counts(table, TOKENIZER).collect())) == want
    assert Counter(map(tuple, token_counts.token_counts(table, TOKENIZER, chunk=13).collect())) == want
    assert token_counts.token_counts(empty, TOKENIZER).count() == 0


def test_chunk_maps_compose_in_any_grouping():
    machine = token_counts.Transducer(**token_counts.load(TOKENIZER), states=50, macros=20)
    text = "It's 12 o'clock,  and\n\nall's   well <|endoftext|>!" * 3
    whole = machine.count(text)
    for size in range(1, 40):
        maps = [machine.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = machine.join(left, m)
        assert machine.finish(left) == machine.finish(machine.compose(maps)) == whole


def test_substring_dedup(docs, empty):
    rows = corpus()
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first: dict[tuple, int] = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, 1 << 62), ident(r[0]))
    want = Counter()
    for r, w in zip(rows, words):
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < ident(r[0]) for p in range(i, i + 13)}
        want[(r[0], len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))] += 1
    assert Counter(map(tuple, substring_dedup.passage_report(docs).collect())) == want
    assert any(0 < k[2] < k[1] for k in want)
    assert substring_dedup.passage_report(empty).count() == 0


def test_equal_substrings_get_equal_symbols():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 8, 60)
    tool = substring_dedup.Passages(13)
    found = []
    for _ in range(2):
        left, right = rng.integers(0, 8, rng.integers(5, 30)), rng.integers(0, 8, 20)
        words = batches.mix(np.concatenate([left, shared, right]).astype(np.uint64))
        keys, start, end = tool.anchors(words, np.array([0, len(words)]))
        inside = (start >= len(left)) & (end <= len(left) + 60)
        found.append(sorted(zip((start - len(left))[inside].tolist(), (end - len(left))[inside].tolist(), keys[inside].tolist())))
    assert found[0] == found[1] and len(found[0]) > 15


def test_language_id(spark, empty):
    rng = random.Random(6)
    vocabulary = {"aa": ["bado", "kiri", "moto", "zula", "pemba"], "bb": ["schtrum", "wolft", "ägen", "krux", "dünn"], "cc": ["elou", "vieux", "àma", "oise", "quel"]}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n)) + "."
    rows = [(i, prose(lang := "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], rng.randint(4, 90)), lang) for i in range(240)]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 ... 34", "bb"), (None, prose("aa", 900), None), (903, "漢字", None)]
    got = {r.doc_id: r for r in language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:240] if got[r[0]].held_out]
    assert 30 < len(held) < 100 and all(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in held)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "aa" and got[903].lang_pred in vocabulary and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.language_report(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.language_report(unlabelled).collect()] == [("und", 0.0)]


def test_phrases_are_the_longest_matches():
    parser = language_id.Parser({"xx": ["the cat sat on the mat", "a dog"], "yy": ["uno dos tres"]})
    rng = random.Random(8)
    texts = ["".join(rng.choice("thecasonmdgu ") for _ in range(rng.randint(0, 700))) for _ in range(50)] + [""]
    counts, _, _ = parser.phrases(texts)
    for k, sample in enumerate(("the cat sat on the mat\na dog", "uno dos tres")):
        known = "".join(map(chr, parser.symbols[parser.codes(sample)]))
        for t, text in enumerate(texts):
            symbols, phrases = "".join(map(chr, parser.symbols[parser.codes(text)])), 0
            for block in range(0, len(symbols), language_id.BLOCK):
                own, at = symbols[block : block + language_id.BLOCK], 0
                while at < len(own):
                    size = 1
                    while at + size < len(own) and own[at : at + size + 1] in known:
                        size += 1
                    at, phrases = at + size, phrases + 1
            assert counts[k][t] == phrases


def test_languages_of_many_scripts():
    """Every letter of the samples counts: 26 Latin, 2 x 33 of two rare scripts and 2 x 120 Chinese letters."""
    rng = random.Random(11)
    scripts = {"en": range(97, 123), "hy": range(0x561, 0x582), "ka": range(0x10D0, 0x10F1), "zh": range(0x4E00, 0x4E78), "ja": range(0x6000, 0x6078)}
    words = {k: ["".join(chr(rng.choice(v)) for _ in range(rng.randint(2, 5))) for _ in range(200)] for k, v in scripts.items()}
    prose = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    parser = language_id.Parser({k: [prose(k, 150) for _ in range(40 if k == "en" else 8)] for k in scripts})
    letters = parser.symbols[[c for v in scripts.values() for c in v]]
    assert len(set(letters.tolist())) == 33 * 2 + 26 + 240 and language_id.OTHER not in letters
    assert parser.symbols[ord("A")] == parser.symbols[ord("a")] and parser.symbols[ord("ж")] == language_id.OTHER
    want = [k for k in scripts for _ in range(20)]
    assert parser([prose(k, 12) for k in want])[0] == want


def test_every_label_is_learned(spark):
    """Seventy labels, the rarest with fewer rows than all others; slices of languages find the same as one."""
    rng = random.Random(12)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(70)}
    prose = lambda k: " ".join(rng.choice(words[k]) for _ in range(12))
    rows = [(i, prose(k), k) for i, k in enumerate(k for k in words for _ in range(3 if k == "l69" else 5))]
    rows += [(1000 + i, prose(k), None) for i, k in enumerate(words)] + [(None, "12", None), (None, None, "l01")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    read = lambda n: [tuple(r) for r in language_id.language_report(docs, at_once=n).collect()]
    key = lambda r: (r[0] or -1, r[2], r[3])
    one = sorted(read(100), key=key)
    assert sorted(read(23), key=key) == one and len(one) == len(rows)
    assert {r[0]: r[2] for r in one if (r[0] or 0) >= 1000} == {1000 + i: k for i, k in enumerate(words)}
    assert sorted(map(key, language_id.language_report(docs).collect())) == sorted(map(key, one))
    kept = language_id.in_known_language(docs, at_once=50)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2


def test_predictions_fill_missing_languages_and_choose(spark):
    rng = random.Random(2)
    words = {"xx": ["alba", "bere", "cori"], "yy": ["zut", "wok", "vyx"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k if i % 4 else None) for i in range(120) for k in [rng.choice(["xx", "yy"])]] + [(500, "12 34", None), (501, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: "xx" if t and t.split()[0] in words["xx"] else "yy" for i, t, _ in rows}
    kept = {r.doc_id: r.lang for r in language_id.in_known_language(docs).collect()}
    assert kept == {i: truth[i] for i in range(120)}
    assert {r.doc_id for r in language_id.in_known_language(docs, ["yy"]).collect()} == {i for i in range(120) if truth[i] == "yy"}


def test_language_stage_rejects_only_texts_without_a_letter(spark):
    """No label at all, the label und, and one null doc_id on all of more than 80 rows a label."""
    schema = "doc_id long, text string, lang string"
    rows = [(i, f"plain words number {i}", None) for i in range(30)] + [(50, "12 -", None), (51, None, None), (52, "", None)]
    assert {r.doc_id for r in language_id.in_known_language(spark.createDataFrame(rows, schema)).collect()} == set(range(30))
    und = [(i, f"plain words number {i}", "und") for i in range(30)]
    assert language_id.in_known_language(spark.createDataFrame(und, schema)).count() == 30
    # with doc_id alone hashed, 0.03 is the rate of each label: all or, most often, none of its rows
    word = {"aa": "bado kiri moto zula", "bb": "schtrum wolft krux", "cc": "elou vieux oise quel"}
    null = spark.createDataFrame([(None, f"{word[k]} {i}", k) for k in word for i in range(2700)], schema)
    (texts,) = language_id.samples(null, 40, 1000, 32)
    assert {k: len(set(v)) for k, v in texts.items()} == {k: 40 for k in word}
    got = language_id.language_report(null).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {k: 2700 for k in word}
    assert language_id.in_known_language(null).count() == 8100
    copies = spark.createDataFrame([(None, word[k], k) for k in word for _ in range(500)], schema)
    assert list(language_id.samples(copies, 40, 1000, 32)) == [{k: [t] for k, t in word.items()}]


def test_displaced_rows_at_the_end_of_the_array(monkeypatch):
    """States that find no free place still get cells of their own."""
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(600))
    part = language_id.Parser({"xx": [text]}).phrases([text[5:300], text[::-1]])[0]
    monkeypatch.setattr(language_id, "TRIES", 1)
    assert (language_id.Parser({"xx": [text]}).phrases([text[5:300], text[::-1]])[0] == part).all()


def test_benchmark_slices_are_scanned_one_after_the_other(spark, monkeypatch):
    """A slice ends inside an item and counts the items of a window; a plan holds one scanner, however many slices."""
    long = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(1, long), (2, long), (3, "seven other words")], "item_id long, text string")
    sets = list(decontaminate.window_sets(bench, 10, 20))
    assert [sum(map(len, s.values())) for s in sets] == [20, 20, 20, 20, 20, 3]
    rows = [(1, "a " + long + " b"), (2, " ".join(long.split()[45:57])), (3, "seven other words"), (4, "nothing here"), (None, None), (2, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = decontaminate.contamination(docs, bench)
    many = decontaminate.contamination(docs, bench, limit=20)
    assert Counter(map(tuple, many.collect())) == Counter(map(tuple, one.collect())) and one.filter("n_items = 2").count() == 3
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert decontaminate.without_contaminated(docs, bench, limit=20).count() == 2
    cut = {r.text for r in decontaminate.without_spans(docs, bench, limit=20).collect()}
    assert cut == {"a  b", "", "nothing here", None}


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(PASSAGE.split()[5:30])), (22, "the SAME line"), (3, None), (4, "!!"), (5, "漢"), (1, "ha-ha ha ha ha ha ha ha ha ha ha ha ha"), (22, "the SAME line")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = Counter()
    for r in corpus():
        words, hit, found = find(r[1]), set(), set()
        for item, text in items:
            own = find(text)
            for i in range(max(1, len(own) - 9) if own else 0):
                window = own[i : i + 10]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        found.add(str(item))
        want[(r[0], len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))] += 1
    assert sum(k[5] for k in want) > 4
    assert Counter(map(tuple, decontaminate.contamination(docs, bench).collect())) == want
    assert Counter(map(tuple, decontaminate.contamination(docs, bench, limit=3).collect())) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.filter("item_id < 0")).filter("contaminated").count() == 0
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[5])
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == docs.columns and decontaminate.contamination(cut, bench).filter("contaminated").count() == 0


def test_items_without_an_id_are_one_item(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (None, "five"), ("a", "one")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (3, 2, sha("None,a")), 2: (1, 1, sha("None")), 3: (0, 0, sha(""))}
