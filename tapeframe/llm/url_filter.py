"""URL filtering by lookup expressions and hash prefixes.

A rule is a host and a path: it fits that host and its subdomains where the path of the
URL starts with the rule's path.  Each distinct (host, path) is expanded into every host
suffix at a label border with at most as many labels as some rule has, times every path
prefix as long as some rule's path; a longer suffix or another length can equal no rule.
Expressions meet the rules by the first four bytes of their SHA-256 in an equi-join, and
the full digest confirms.  The longest rule wins: by host and path together, then by host,
then a block before an allow.  URLs without a rule are allowed: no list names them.

A null URL, or one without ``://``, has empty host and path.  Equal URLs are judged once,
so a host or URL with a third of all rows is few rows in the joins; repeated page rows
each get their row; other columns are not looked at.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path, both empty where there is none."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", text) > 0, F.expr(f"substr({url}, locate('://', {url}) + 3)")).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(before, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(before, r"(?s)^[^/]*(.*)$", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digest; of equal rules a block wins."""
    whole = F.concat("host", "path")
    return rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.col("host").alias("rule_host"), whole.alias("rule"), "verdict", F.sha2(F.concat_ws("\t", "host", "path").cast("binary"), 256).alias("rule_digest")
    )


def expressions(places: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(host, path, digest) of every lookup expression of each (host, path)."""
    parts = F.split("host", r"\.")
    suffixes = F.expr(f"transform(sequence(1, least({labels}, size(parts))), n -> array_join(slice(parts, -n, n), '.'))")
    prefixes = F.expr(f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length(path)), n -> substr(path, 1, n))")
    hosts = places.withColumn("parts", parts).withColumn("suffix", F.explode(suffixes))
    whole = F.concat_ws("\t", "suffix", "prefix")
    return hosts.withColumn("prefix", F.explode(prefixes)).select("host", "path", F.sha2(whole.cast("binary"), 256).alias("digest"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``rules`` has host, path and verdict."""
    host, path = host_and_path("url")
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    table = rule_table(rules)
    bounds = rules.select(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    if not bounds.labels:
        return placed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    short = lambda c: F.substring(c, 1, 8)
    found = expressions(placed.select("host", "path").distinct(), bounds.labels, sorted(bounds.lengths)).withColumn("short", short("digest"))
    hits = found.join(table.withColumn("short", short("rule_digest")), "short").filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), F.length("rule_host"), "verdict", "rule")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.verdict")
    joined = placed.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
