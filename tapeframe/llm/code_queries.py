"""The registered queries of vector codes and the filter audit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeframe.llm.batches import documents
from tapeframe.llm.filter_audit import audit
from tapeframe.llm.vector_codes import code_report


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


def _assigned(name: str, book: str) -> str:
    """Cells with the entry of ``book`` nearest to each."""
    return f"""{name} AS (
  SELECT p, x, n, e, off FROM (
    SELECT c.p, c.x, c.n, b.e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS off,
      row_number() OVER (PARTITION BY c.p, c.x ORDER BY off, b.e) AS turn
    FROM cells c JOIN {book} b ON c.p = b.p
  ) WHERE turn = 1
)"""


def _improved(name: str, book: str, assigned: str) -> str:
    """Entries of ``book`` moved to the floor of the mean of their cells."""
    return f"""{name} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS x FROM (
      SELECT p, e, i, floor(sum(v * n)::DOUBLE / sum(n))::BIGINT AS v
      FROM (SELECT p, e, n, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM {assigned}) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m ON b.p = m.p AND b.e = m.e
)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS FIRST, embedding) AS row, vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), pieces AS (
  SELECT row, vec_id, label, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS p FROM kept)
), cells AS (
  SELECT p, x, count(*) AS n FROM pieces GROUP BY p, x
), book0 AS (
  SELECT p, row - 1 AS e, x FROM pieces WHERE row <= 64
), {_assigned("near0", "book0")}, {_improved("book1", "book0", "near0")}, {_assigned("near1", "book1")}, {_improved("book2", "book1", "near1")}, {_assigned("near2", "book2")},
coded AS (
  SELECT s.row, s.vec_id, s.label, string_agg(printf('%02x', n.e), '' ORDER BY s.p) AS code, sum(n.off)::BIGINT AS error
  FROM pieces s JOIN near2 n ON s.p = n.p AND s.x = n.x GROUP BY ALL
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS d FROM book2
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, d AS codebooks_sha256 FROM coded, digest
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(documents(spark, sf_dir, "doc_id", "text", "lang"), labels)


OP13_SQL = r"""
WITH texts AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS text, regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), judged AS (
  SELECT part, good, toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM texts
), counts AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, s AS step, o[s] AS f, left(o, s - 1) AS earlier FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders)
), audited AS (
  SELECT c.part, s.o AS filter_order, s.step, s.f,
    sum(CASE WHEN translate(s.earlier || s.f, c.fails, '') = s.earlier || s.f THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(s.earlier, c.fails, '') = s.earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(s.earlier, c.fails, '') <> s.earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN c.fails = s.f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(s.earlier, c.fails, '') = s.earlier THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(c.fails, s.f) AND translate(s.earlier, c.fails, '') = s.earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts c, steps s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM audited
"""
