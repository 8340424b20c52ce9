"""Set operations between screens and precedence between sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def double_signal(a: DataFrame, b: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Instruments that pass both screens."""
    return a.select(key).intersect(b.select(key))


def soft_only(soft: DataFrame, strict: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Rows of the soft screen that the strict one does not have."""
    return soft.join(strict.select(key), key, "left_anti")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, as one aggregation with partial results."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [F.col(c) for c in order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*ordered)).alias("__first"))
    return first.select(*keys, "__first.*").select(*df.columns)


def by_precedence(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources where the earlier source wins each key."""
    stacked = reduce(
        DataFrame.unionByName, [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    )
    w = Window.partitionBy(key).orderBy("__source")
    return stacked.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k", "__source")


def ranked_union(sets: Sequence[DataFrame], key: str, size: str, n: int) -> DataFrame:
    """Distinct union of name sets, the n largest by size."""
    names = reduce(DataFrame.unionByName, [s.select(key, size) for s in sets]).groupBy(key).agg(F.max(size).alias(size))
    return names.orderBy(F.col(size).desc(), key).limit(n)


def relabel(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Display names for the columns that are present."""
    return df.withColumnsRenamed({k: v for k, v in labels.items() if k in df.columns})
