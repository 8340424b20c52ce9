"""The queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeframe.llm.batches import documents
from tapeframe.llm.code_queries import OP12_SQL, OP13_SQL, op12_vector_codes, op13_filter_audit
from tapeframe.llm.decontaminate import contamination
from tapeframe.llm.language_id import language_report
from tapeframe.llm.line_dedup import line_report
from tapeframe.llm.mixing import mix_report
from tapeframe.llm.near_dedup import near_report
from tapeframe.llm.neighbours import neighbours
from tapeframe.llm.parity_join import join_report
from tapeframe.llm.secret_scan import secret_spans
from tapeframe.llm.substring_dedup import passage_report
from tapeframe.llm.url_filter import judge


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir, "doc_id", "text"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS dropped FROM lines l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir, "doc_id", "text", "source"))


OP2_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source
), weighted AS (
  SELECT source, source_size, 3 * source_size AS cap, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight FROM sums
), rounds(round, capped, level) AS (
  SELECT 0, 0::BIGINT, (SELECT sum(source_size) / sum(weight) FROM weighted)
  UNION ALL
  SELECT round + 1,
    (SELECT count(*) FROM weighted WHERE r.level * weight > cap),
    ((SELECT sum(source_size) FROM weighted) - coalesce((SELECT sum(cap) FROM weighted WHERE r.level * weight > cap), 0))
      / (SELECT sum(weight) FROM weighted WHERE r.level * weight <= cap)
  FROM rounds r
  WHERE (SELECT count(*) FROM weighted WHERE r.level * weight > cap) > r.capped
), level AS (
  SELECT max(level) AS level FROM rounds
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target FROM weighted, level
), tape AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('42:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(least(start + size, take) - start, 0) + greatest(least(start + source_size + size, take) - start - source_size, 0)
    + greatest(least(start + 2 * source_size + size, take) - start - 2 * source_size, 0) AS BIGINT) AS taken
FROM tape
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir, "doc_id", "text"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP5_SQL = """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages
), placed AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(r, length(regexp_extract(r, '^[^/]*')) + 1) AS path
  FROM rest
), hits AS (
  SELECT d.host, d.path, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY d.host, d.path ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.v DESC) AS n
  FROM (SELECT DISTINCT host, path FROM placed) d JOIN rules r ON (d.host = r.h OR ends_with(d.host, '.' || r.h)) AND starts_with(d.path, r.p)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.v, 'allow') AS verdict
FROM placed p LEFT JOIN hits h ON p.host = h.host AND p.path = h.path AND h.n = 1
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(documents(spark, sf_dir, "doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tapeframe.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(documents(spark, sf_dir, "doc_id", "text"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS least FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT x.doc_id, x.i FROM windows x JOIN firsts f ON x.win = f.win AND f.least < x.doc_id)
), places AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words
), kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS listed, count(*) AS n FROM places a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.listed, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), found AS (
  SELECT s.doc_id, s.i, s.n, t.item_id
  FROM (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
  ) s JOIN windows t ON s.n = t.n AND s.win = t.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_report(documents(spark, sf_dir, "doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n, string_agg(s, chr(10) ORDER BY s) AS listed FROM shingles GROUP BY doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY listed) AS rep FROM sizes
), held AS (
  SELECT h.doc_id, h.s, c.n FROM shingles h JOIN classes c ON h.doc_id = c.doc_id AND c.doc_id = c.rep
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(least(c.rep, l.b), d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN classes c ON d.doc_id = c.doc_id LEFT JOIN least l ON c.rep = l.a
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_url_filter": op5_url_filter,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_jaccard_join": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
