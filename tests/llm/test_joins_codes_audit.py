"""Parity join, vector codes and filter audit against plain versions; inputs that once gave wrong results."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tapeframe.llm import batches, counting, filter_audit, near_dedup, neighbours, parity_join, substring_dedup, vector_codes
from tests.llm.test_operators import SCHEMA, brute_classes, corpus, ident


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that differ in every letter and have one polynomial in every odd base modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


# words, letters and texts that polynomial hashes confuse


def test_words_of_any_pattern_have_hashes_of_their_own():
    one, two = thue_morse(1024)
    words = [one, two, one[:512], two[:512], one * 4, two * 4, "a", "b", "ab", "abcdefgh", "abcdefghi", "bbcdefghi", "abcdefgh\0", "x" * 1024, "x" * 1025]
    data, offsets = batches.text_bytes(pa.array([" ".join(words), words[3]]))
    hashes, rows, _, _ = batches.space_words(lower=False)(data, offsets)
    assert len(set(hashes[: len(words)].tolist())) == len(words) and hashes[-1] == hashes[3] and rows.tolist() == [0, len(words), len(words) + 1]


def test_unequal_words_are_not_taken_for_equal(spark):
    one, two = thue_morse(1024)
    rest = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, one), (4, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.passage_report(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    apart = {3: 3, 4: 4}
    assert {r.doc_id: r.component_id for r in near_dedup.near_report(docs).collect() if r.doc_id > 2} == apart
    assert {r.doc_id: r.component_id for r in parity_join.join_report(docs).collect() if r.doc_id > 2} == apart


def test_clusters_of_many_blocks_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 1)
    monkeypatch.setattr(near_dedup, "FEW_BLOCKS", 400)
    monkeypatch.setattr(near_dedup, "OUT_BYTES", 1 << 16)
    base = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"tail{i}"])) for i in range(60)], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_report(docs).collect()} == {0}


def test_repeated_rows_take_no_neighbours_place(spark):
    same, near = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.1]
    rows = [(1, same)] * 15 + [(v, same) for v in (15, 55, 88)] + [(100000, near)] + [(1000 + i, [50.0 + i, 2.0, 3.0, 4.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in neighbours.neighbours(table, every=100000).orderBy("rank").collect()]
    assert got == [1, 15, 55, 88, 1000, 1001, 1002, 1003, 1004, 1005]


def test_an_id_with_several_vectors_has_the_least(spark):
    rows = [(0, [1.0, 1.0]), (0, [9.0, 9.0]), (7, [8.0, 8.0]), (7, [2.0, 1.0]), (8, [9.0, 8.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.neighbours(table).orderBy("rank").collect()]
    assert got == [(1, 7, 1.0), (2, 8, round(math.sqrt(113), 6))]


# parity join


def edited(rng: random.Random, base: list[str], edits: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"new{rng.random()}"], [f"new{rng.random()}", out[at]]])
    return out


def near_texts() -> list[tuple]:
    """Texts of very different lengths about the threshold, chains, a common passage, and sets inside sets."""
    rng, rows = random.Random(17), []
    passage = [f"common{i}" for i in range(40)]
    for size in (1, 3, 5, 8, 9, 12, 20, 43, 44, 45, 60, 150, 178, 181, 230, 700, 730, 900):
        base = [f"s{size}w{i}" for i in range(size)]
        rows.append(" ".join(base))
        rows += [" ".join(edited(rng, base, rng.randint(0, max(1, size // 25)))) for _ in range(6)]
        rows += [" ".join(base + [f"more{i}" for i in range(extra)]) for extra in (1, max(1, (size - 4) // 4), max(1, (size - 4) // 4) + 1)]
    for i in range(30):
        rows.append(" ".join([f"d{i}w{j}" for j in range(rng.randint(5, 60))] + passage))
    chain = [f"c{i}" for i in range(100)]
    for i in range(15):
        chain = chain[2:] + [f"link{i}a", f"link{i}b"]
        rows.append(" ".join(chain))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 60), (3, 95)])
def test_parity_join_loses_no_link(spark, words, percent, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 4)
    monkeypatch.setattr(parity_join, "CHUNK", 3)
    monkeypatch.setattr(parity_join, "FLUSH", 2000)
    rows = near_texts()
    got = Counter(map(tuple, parity_join.join_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words, percent).collect()))
    want = brute_classes(rows, words, percent)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 60


def test_parity_join_of_odd_tables(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, ident(r.component_id)) for r in parity_join.join_report(docs).collect())
    assert got == brute_classes(corpus(), 5, 80)
    assert parity_join.join_report(docs.limit(0)).count() == 0


def test_an_id_with_several_texts_is_linked_by_each(spark):
    x, y, z = ([f"{c}{i}" for i in range(60)] for c in "xyz")
    rows = [(1, y), (3, x), (3, y), (7, x), (8, x[:-1]), (9, y[1:]), (10, z), (10, None)]
    docs = spark.createDataFrame([(d, t and " ".join(t)) for d, t in rows], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.join_report(docs).collect())
    assert got == Counter({(1, 56, 1): 1, (3, 56, 1): 2, (7, 56, 1): 1, (8, 55, 1): 1, (9, 55, 1): 1, (10, 56, 10): 1, (10, 0, 10): 1})


def test_sketch_distances_are_lower_bounds():
    rng, tool = np.random.default_rng(4), parity_join.Sketcher(5, 80)
    for size in (4, 30, 44, 45, 300, 3000):
        for change in (0, 1, size // 5, size):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = np.unique(np.concatenate([a[change // 2 :], rng.integers(0, 1 << 63, change, np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert parity_join.distances([tool.narrow(a), tool.narrow(b)])[0, 1] <= apart
            if apart * 9 <= len(a) + len(b) and apart:
                offered = [{int(k) for keys, need in tool.keys(s) for k in np.sort(keys)[:need]} for s in (a, b)]
                assert offered[0] & offered[1]


def test_percent_out_of_range():
    with pytest.raises(ValueError):
        parity_join.Sketcher(5, 50)


# vector codes


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int) -> list[tuple]:
    """rows: vec_id, label, integers."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    cut = lambda v: [tuple(v[i * len(v) // parts : (i + 1) * len(v) // parts]) for i in range(parts)]
    pieces = [cut(r[2]) for r in rows]
    books = [[p[i] for p in pieces[:entries]] for i in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda i, piece: min(range(len(books[i])), key=lambda e: (far(piece, books[i][e]), e))
    for _ in range(rounds):
        own = [[best(i, p[i]) for i in range(parts)] for p in pieces]
        for i in range(parts):
            books[i] = [
                tuple(sum(c) // len(c) for c in zip(*(p[i] for p, o in zip(pieces, own) if o[i] == e))) if any(o[i] == e for o in own) else entry for e, entry in enumerate(books[i])
            ]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for r, p in zip(rows, pieces):
        codes = [best(i, p[i]) for i in range(parts)]
        error = sum(far(p[i], books[i][c]) for i, c in enumerate(codes))
        sums[r[1]] += error
        out.append((r[0], "".join(f"{c:02x}" for c in codes), error, r[1]))
    return [(v, c, e, sums[label], digest) for v, c, e, label in out]


@pytest.mark.parametrize("scale", [1.0, 0.01, 1e5])
def test_vector_codes(spark, scale, monkeypatch):
    monkeypatch.setattr(vector_codes, "FRONTIER", 16)
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(150, 32)) * scale).astype(np.float32)
    points[60:90] = points[60]
    rows = [(int(i) * 3 % 151, None if i % 5 == 0 else int(i % 3), p.tolist(), "x") for i, p in enumerate(points)]
    rows += [(None, 1, points[3].tolist(), "x"), (6, 2, points[4].tolist(), "x"), rows[2], rows[2]]
    odd = [(-1, 1, None, "x"), (-2, 1, [], "x"), (-3, 1, [float("nan")] * 32, "x"), (-4, 1, [None] * 32, "x"), (-5, 1, [1.0] * 16, "x"), (-6, 1, [float("inf")] * 32, "x"), (-7, 1, [1.0] * 33, "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>, code string").repartition(3)
    want = plain_codes([(v, label, [math.floor(256 * float(np.float32(x))) for x in e]) for v, label, e, _ in rows], 16, 64, 2)
    assert Counter(map(tuple, vector_codes.code_report(table).collect())) == Counter(want)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(5, 1, [float(i) for i in range(16)]), (2, None, [0.5] * 16)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r for r in vector_codes.code_report(few).collect()}
    assert got[2].code == "00" * 16 and got[5].code == "01" * 16 and {r.error for r in got.values()} == {0}
    assert vector_codes.code_report(few.limit(0)).count() == 0


def test_trie_shares_prefixes_and_breaks_ties_low():
    rng = np.random.default_rng(2)
    values, book = rng.integers(-3, 3, (5000, 4)), rng.integers(-3, 3, (64, 4))
    trie = vector_codes.Trie(values)
    assert np.array_equal(trie.rows[trie.place], values) and len(trie.rows) == len(np.unique(values, axis=0))
    codes, errors = trie.nearest(book)
    apart = ((trie.rows[:, None] - book[None]) ** 2).sum(axis=2)
    assert np.array_equal(codes, apart.argmin(axis=1)) and np.array_equal(errors, apart.min(axis=1))


# filter audit


def plain_audit(docs: list[tuple], labels: list[tuple]) -> Counter:
    """docs: doc_id, text, lang."""
    least, good, toxic = {}, set(), set()
    for d, t, _ in docs:
        least[t or ""] = min(least.get(t or "", 1 << 62), ident(d))
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    judged = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": ident(d) > least[t]}
        judged.append((lang or "", {f for f, x in fails.items() if x}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part in {j[0] for j in judged}:
        own, removed_by, lines = [j for j in judged if j[0] == part], Counter(), []
        for order in itertools.permutations("ABCDE"):
            for s, f in enumerate(order):
                before, gone = set(order[:s]), [j for j in own if f in j[1] and not j[1] & set(order[:s])]
                removed_by[f] += len(gone)
                row = [part, "".join(order), s + 1, sum(not j[1] & (before | {f}) for j in own), len(gone), sum(f in j[1] and bool(j[1] & before) for j in own)]
                lines.append((f, (*row, sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone))))
        out += [(*row, removed_by[f]) for f, row in lines]
    return Counter(out)


def audit_rows() -> tuple[list, list]:
    rng, docs = random.Random(6), []
    texts = [None, "", " ", "short", "Short TEXT", "a#b", "word " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"w{i}%" for i in range(210)), "é漢ÜA " * 5]
    texts += [" ".join(f"{c}{i}" for i in range(199 + k)) for k, c in enumerate("xyzu")]
    for i in range(120):
        docs.append((i, rng.choice(texts), rng.choice(["en", "fr", None, "", "de"])))
    docs += [(None, "short", "en"), (5, "another text of one id", "en"), docs[3], docs[3]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("cells", [1 << 28, 1 << 16])
def test_filter_audit(spark, cells, monkeypatch):
    monkeypatch.setattr(counting, "SLICE_CELLS", cells)
    monkeypatch.setattr(counting, "CELLS_PER_HASH", 8 if cells > 1 << 20 else 1200)  # the second case tests three slices
    monkeypatch.setattr(filter_audit, "CHUNK", 50)
    docs, labels = audit_rows()
    table = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], "doc_id long, text string, lang string, mask string, digest string, part string").repartition(3)
    told = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, doc string")
    got = filter_audit.audit(table, told)
    assert got.columns[:3] == ["part", "filter_order", "step"]
    assert Counter(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(table.limit(0), told).count() == 0
    assert filter_audit.audit(table, told.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_possible_repeats_miss_none_and_clear_most(spark):
    rows = spark.range(0, 20000).selectExpr("xxhash64(id) AS hash", "id").union(spark.range(0, 20000, 11).selectExpr("xxhash64(id) AS hash", "id + 100000"))
    tested = counting.possible_repeats(rows, "test")
    assert tested.columns == ["hash", "id", "maybe"] and tested.count() == 20000 + 1819
    assert tested.filter("NOT maybe AND (id >= 100000 OR id % 11 = 0)").count() == 0
    assert tested.filter("maybe AND id % 11 <> 0 AND id < 100000").count() < 2500
