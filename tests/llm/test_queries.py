"""The registered corpus queries over whole small tables: against SQL, the library, brute force or labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tapeframe.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import brute_classes, targets
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def rows(con):
    return con.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    result = compare(con, QUERIES[name](spark, SF), ORACLES[name])
    assert result.startswith("ok") and "EMPTY" not in result, result


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_near_dedup_query(spark, rows):
    got = QUERIES["op6_near_dedup"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_token_query(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t, _, _ in rows}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op7_token_counts"](spark, SF).collect()} == want


def test_language_query_on_held_out_documents(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, SF).collect()}
    held = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 20 and all(got[r[0]].held_out for r in held)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)


def test_neighbour_query_recall(spark, con):
    table = con.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, points = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.float64)
    found = {}
    for r in QUERIES["op4_nearest_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, own in found.items():
        distance = np.sqrt(((points - points[ids == q][0]) ** 2).sum(axis=1))
        hits += len(own & {int(ids[i]) for i in np.lexsort((ids, distance)) if ids[i] != q and i in np.argsort(distance, kind="stable")[:12]})
    assert set(found) == {int(i) for i in ids if i % 100 == 0} and hits >= 0.9 * 10 * len(found)


def test_secret_query_covers_every_row(spark, rows):
    got = QUERIES["op3_secret_scan"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    hexes = {r[0]: len([m for m in re.findall(r"[0-9a-f]+", r[1] or "") if len(m) >= 24]) for r in rows}
    assert {r.doc_id: r.n_hex for r in got} == hexes


def test_pipeline_stages_against_brute_force(spark, con, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert {r.doc_id for r in known.collect()} == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    lines = stages["line_dedup"](spark, known, SF).cache()
    assert lines.columns == columns and lines.filter("n_chars <> length(text)").count() == 0 and lines.count() == known.count()
    single = stages["near_dedup"](spark, lines, SF).cache()
    classes = brute_classes([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in classes if d == c} and single.columns == columns
    clean = stages["decontamination"](spark, single, SF).cache()
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for (text,) in con.sql("SELECT text FROM benchmark").fetchall():
        w = find(text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    dirty = {r.doc_id for r in single.collect() for w in [find(r.text)] if any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - dirty and clean.columns == columns
    mixed = stages["mixing"](spark, clean, SF).collect()
    sums = Counter()
    source = {r.doc_id: r.source for r in clean.collect()}
    for r in mixed:
        sums[source[r.doc_id]] += r.size
    want, taken = targets(sums), Counter()
    for r in mixed:
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in sums)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter(whole) == Counter(mixed)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "empty")
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
