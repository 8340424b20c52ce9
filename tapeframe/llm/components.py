"""Connected components of an edge table, by alternating stars.

Large stars hand every larger neighbour to a node's least neighbour, small stars every
smaller one; the two end in one star for each component after about as many rounds as the
logarithm of its diameter.  Minima are aggregated before the shuffle, so a node with very
many neighbours is one row a task.  They are written to the shared folder before edges meet
them: a join of two plain shuffles is one that Spark splits where a node is skewed.  Each
round is written too, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.session import cut_lineage


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(cut_lineage(least, "least"), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = edges.join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of ``edges`` that is not the least of its component, and that least node.

    ``edges`` has long columns a and b; loops, repeated and reversed edges do no harm.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges, "edges")
    state = summary(edges)
    while state[0]:
        edges = cut_lineage(small_star(large_star(edges)), "edges")
        before, state = state, summary(edges)
        if before == state:
            break
    return edges


def summary(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
