"""Exact quantiles of a column, whole or per group, without one task per group.

**Whole tables** take two passes.  The first merges a sketch of each task: it brackets every
wanted rank between two values.  The second counts what lies below each bracket and keeps
only the values inside, about ``SPARE`` of the ranks on either side.  Nothing is stored, and
what is shuffled is a share of the table.  The brackets are checked by the counts: a result
is exact, or the query fails.

**Groups** are counted by value before the shuffle and binned on a logarithmic scale.  Bin
totals locate the wanted ranks; only the few bins that hold them are ranked by value.  A
task sees at most the distinct values of one bin (a thousandth of a magnitude), so a
group may hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Bins per unit of the natural logarithm, and the value scale below which bins get linear.
BINS_PER_LOG, SCALE = 1000, 1e6
# The sketch errs by 1 / ACCURACY of the ranks at most; brackets reach five times as far.
ACCURACY, SPARE = 2000, 0.0025


def log_bin(c: Column) -> Column:
    """A monotone bin number: about 41,000 bins either side of zero reach up to 1e12."""
    return (F.signum(c) * F.floor(F.log1p(F.abs(c) * SCALE) * BINS_PER_LOG)).cast("long")


def brackets(src: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, n, lows, highs): values below and above the wanted ranks, by the merged sketch of each group."""
    bounds = [min(1.0, max(0.0, p + side * SPARE)) for side in (-1, 1) for p in probs]
    found = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, bounds, F.lit(ACCURACY)).alias("__b"))
    return found.select(*keys, "n", F.slice("__b", 1, len(probs)).alias("lows"), F.slice("__b", len(probs) + 1, len(probs)).alias("highs"))


def bracketed_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Quantiles of a whole table or of few, large groups: sketches bracket the ranks, and only values inside are shuffled.

    There is one sketch a group and task.
    """
    by = list(by)
    keys = by or ["__all"]
    src = (df if by else df.withColumn("__all", F.lit(0))).filter(F.col(value).isNotNull())
    src = src.select(*keys, F.col(value).cast("double").alias("__v"))
    bounds = brackets(src, "__v", probs, keys)
    # one row a group; Spark's own size check decides how it meets the values
    v, n = F.col("__v"), F.col("n")
    sides = F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.struct(
        i.alias("i"),
        F.when(v < F.get("lows", i), -1).when(v > F.get("highs", i), 1).otherwise(0).alias("side"),
    ))
    placed = src.join(bounds, keys).withColumn("__p", F.explode(sides)).select(*keys, "n", "__v", F.col("__p.i").alias("__i"), F.col("__p.side").alias("side"))
    # a row for each value inside, and one for all that is below or above
    inside = F.col("side") == 0
    counts = placed.groupBy(*keys, "n", "__i", "side", F.when(inside, v).alias("__w"), F.when(inside, log_bin(v)).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__c"), F.max("__v").alias("__hi"), F.min("__v").alias("__lo")
    )
    # below, the bins inside and above in order; a bin's rank starts after those before it
    group = Window.partitionBy(*keys, "__i")
    bins = counts.groupBy(*keys, "n", "__i", "side", "__bin").agg(F.sum("__c").alias("__n"))
    upto = group.orderBy("side", F.col("__bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    places = [*keys, "__i", "side", "__bin"]
    starts = bins.select(*[F.col(k).alias(f"__at_{k}") for k in places], F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    prob = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("__i"))
    rank = (n - 1) * prob
    in_bin = Window.partitionBy(*keys, "__i", "side", "__bin").orderBy("__w").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in places]
    ranked = counts.join(starts, same).select(*counts.columns, "__start")
    ranked = ranked.withColumn("__to", F.sum("__c").over(in_bin) + F.col("__start")).withColumn("__from", F.col("__to") - F.col("__c"))

    def at(r: Column) -> Column:
        """The value of rank ``r``, if this row has it: inside, or next to the bracket."""
        held = (r > F.col("__from")) & (r <= F.col("__to"))
        return F.when(
            held & inside, F.col("__w")
        ).when(held & (F.col("side") < 0) & (r == F.col("__to")), F.col("__hi")).when(held & (F.col("side") > 0) & (r == F.col("__from") + 1), F.col("__lo"))

    ends = ranked.groupBy(*keys, "n", "__i").agg(F.max(at(F.floor(rank) + 1)).alias("lo"), F.max(at(F.ceil(rank) + 1)).alias("hi"))
    exact = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    q = F.when(exact, F.col("lo") + (F.col("hi") - F.col("lo")) * (rank - F.floor(rank))).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")))
    cols = [F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"__q{i}") for i in range(len(probs))]
    out = ends.withColumn("__q", q).groupBy(*keys, "n").agg(*cols)
    return out.select(*by, "n", F.array(*[f"__q{i}" for i in range(len(probs))]).alias("q"))


def binned_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str],
) -> DataFrame:
    """Quantiles of many groups: all values are counted by value and bin, and the bins that hold the wanted ranks are ranked.

    Groups are dates or bins, never instruments: at most two bins per probability and
    group are joined.
    """
    keys = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, log_bin(F.col(value)).alias("__bin"), F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__bin_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (F.floor((F.col("n") - 1) * float(p)) + 1).alias("lo"),
                (F.ceil((F.col("n") - 1) * float(p)) + 1).alias("hi"),
                ((F.col("n") - 1) * float(p) - F.floor((F.col("n") - 1) * float(p))).alias("frac"),
            )
            for i, p in enumerate(probs)
        ]
    )
    wanted = (
        bins.withColumn("n", F.sum("__bin_n").over(group))
        .withColumn("__end", F.sum("__bin_n").over(upto))
        .withColumn("__start", F.col("__end") - F.col("__bin_n"))
        .withColumn(
            "__ranks",
            F.filter(
                ranks,
                lambda r: ((r.lo > F.col("__start")) & (r.lo <= F.col("__end")))
                | ((r.hi > F.col("__start")) & (r.hi <= F.col("__end"))),
            ),
        )
        .filter(F.size("__ranks") > 0)
        .select(*keys, "__bin", "n", "__start", "__ranks")
    )
    in_bin = Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counts.join(wanted, [*keys, "__bin"])
        .withColumn("__to", F.sum("__c").over(in_bin) + F.col("__start"))
        .withColumn("__from", F.col("__to") - F.col("__c"))
        .withColumn("__r", F.explode("__ranks"))
        .groupBy(*keys, "n", F.col("__r.i").alias("__i"), F.col("__r.frac").alias("__f"))
        .agg(
            F.max(F.when((F.col("__r.lo") > F.col("__from")) & (F.col("__r.lo") <= F.col("__to")), F.col("__v"))).alias("lo"),
            F.max(F.when((F.col("__r.hi") > F.col("__from")) & (F.col("__r.hi") <= F.col("__to")), F.col("__v"))).alias("hi"),
        )
        .withColumn("__q", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("__f"))
    )
    cols = [
        F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(f"__q{i}") for i in range(len(probs))
    ]
    out = hits.groupBy(*keys, "n").agg(*cols)
    return out.select(*keys, "n", F.array(*[f"__q{i}" for i in range(len(probs))]).alias("q"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group: ``by`` columns, ``n`` and ``q`` (array in order of ``probs``).

    Linear interpolation between the two neighbouring ranks.  A whole table is bracketed by
    sketches; of groups, of which there may be thousands, all values are counted by bin.
    """
    return binned_quantiles(df, value, probs, by) if by else bracketed_quantiles(df, value, probs)


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` columns and ``median``."""
    q = exact_quantiles(df, value, [0.5], by)
    return q.select(*by, F.col("q")[0].alias("median"))


def with_scalar(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as a scalar subquery."""
    packed = one_row.select(F.struct(*names).alias("__row")).scalar()
    out = df.withColumn("__row", packed)
    return out.select(*df.columns, *[F.col(f"__row.{n}").alias(n) for n in names])


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal-count bins 1..bins: right-closed, the lowest value included.

    Equal edges fall together, so their bins are dropped and numbering stays dense.
    """
    edges = exact_quantiles(df, value, [i / bins for i in range(bins + 1)])
    edges = edges.select(F.array_distinct("q").alias("__edges"))
    placed = with_scalar(df.filter(F.col(value).isNotNull()), edges, "__edges")
    v = F.col(value)
    # number of inner edges strictly below v, plus one
    below = F.size(F.filter(F.slice(F.col("__edges"), 2, bins), lambda e: e < v))
    return placed.withColumn(out, (below + 1).cast("int")).drop("__edges")


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` 1..n over the whole table without putting it into one task.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted
    by the sizes of the partitions before (one row per partition).
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(
        placed.withColumn("__id", F.monotonically_increasing_id()), "rank"
    )
    part, pos = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__offset"))
    ranked = placed.withColumn("__p", part).join(offsets, "__p")
    return ranked.withColumn("rank", pos + F.col("__offset") + 1).drop("__p", "__id", "__offset")


def rank_bins(df: DataFrame, bins: int, *order: str, out: str = "bin") -> DataFrame:
    """Equal-count bins of the rank, for values with too many ties for value edges."""
    ranked = global_rank(df, *order)
    n = ranked.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return ranked.withColumn(
        out, F.greatest(F.lit(1), F.ceil((F.col("rank") - 1) * bins / F.greatest(n - 1, F.lit(1)))).cast("int")
    )
