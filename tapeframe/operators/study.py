"""Event studies: forward returns after a signal and how they differ by factor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LockScreen
from ..functions.columns import pct_simple, ratio
from ..functions.quantiles import exact_median, exact_quantiles, rank_bins, with_scalar
from ..functions.windows import newest_first, ordered
from ..session import cut_lineage
from ..sources.calendar import on_last_dates
from . import brokers
from .joins import enrich
from .screens import limit_up_candidates


def lock_study(price: DataFrame, nets: DataFrame, calendar: DataFrame, p: LockScreen = LockScreen(), top: int = 15) -> DataFrame:
    """Every historical lock candidate with its next-date gap, intraday and close returns.

    ``hits``: most flips in the window among today's top buyers; ``hit_top5``: one of the
    regulars is among the five largest.
    """
    cands = limit_up_candidates(price, calendar, p, every_date=True)
    nxt = price.select(
        "instrument_id", F.col("date").alias("next_date"), F.col("open").alias("next_open"), F.col("close").alias("next_close")
    )
    rows = cands.select("date", "instrument_id", "close", "change_pct").join(calendar.select("date", "next_date", "idx"), "date")
    rows = rows.filter(F.col("idx") >= p.lookback).join(nxt, ["instrument_id", "next_date"]).filter("next_open > 0 AND next_close > 0")
    main = brokers.broker_main_net(nets, top).select("instrument_id", "date", "main_net")
    regular = brokers.top_buyers(nets, top).join(
        brokers.regular_hits(nets, calendar, p.lookback, top), ["instrument_id", "broker", "date"]
    ).groupBy("instrument_id", "date").agg(F.max("hits").alias("hits"), F.max((F.col("rank") <= 5).cast("int")).alias("hit_top5"))
    joined = rows.join(main, ["instrument_id", "date"]).join(regular, ["instrument_id", "date"], "left")
    locked = F.col("main_net") > 0
    o, c = F.col("next_open"), F.col("close")
    return joined.select(
        "date", "instrument_id", "change_pct", "main_net", locked.cast("int").alias("locked"),
        F.when(locked, F.coalesce("hits", F.lit(0))).otherwise(0).cast("long").alias("hits"),
        F.when(locked, F.coalesce("hit_top5", F.lit(0))).otherwise(0).alias("hit_top5"),
        pct_simple(o, c).alias("gap"), pct_simple("next_close", o).alias("oc"), pct_simple("next_close", c).alias("cc"),
    )


def pressure_study(price: DataFrame, nets: DataFrame, universe: DataFrame | None = None, top: int = 15) -> DataFrame:
    """Flip pressure and main net of each bar with the return into it and out of it.

    Bars step along the instrument's own dates and need one on either side.  Bars and broker
    rows are stacked and cross one exchange, by instrument; what the buyers of the date before
    sold is looked up in the instrument's own rows.
    """
    if universe is not None:
        price = price.join(universe.select("instrument_id"), "instrument_id", "left_semi")
        nets = nets.join(universe.select("instrument_id"), "instrument_id", "left_semi")
    cells = price.select("instrument_id", "date", F.struct("close", "volume").alias("bar"))
    entries = nets.select("instrument_id", "date", F.struct("broker", "net").alias("entry"))
    rows = brokers.by_bar(cells.unionByName(entries, allowMissingColumns=True), F.first("bar", True).alias("bar"))
    # a date may have a bar, broker rows or both; a row without a date comes first, and its buyers meet nothing
    before, after = (by("instrument_id").rowsBetween(Window.unboundedPreceding, -1) for by in (ordered, newest_first))
    rows = rows.withColumns({
        "prev": F.last("bar", True).over(before), "next": F.last("bar", True).over(after),
        "held": F.last(F.when(F.size("entries") > 0, F.filter("entries", lambda x: F.col("date").isNotNull())), True).over(before),
    }).filter("date is not null AND bar is not null AND size(entries) > 0 AND held is not null")
    close = F.col("bar.close")
    # a bar whose previous date had no buyer at all has no pressure, not a missing one
    sales = brokers.bar_sales(F.col("held"), F.col("entries"), top)
    overlap = F.aggregate(sales, F.lit(0.0), lambda total, x: total + brokers.dumped(x.bought, x.after))
    return rows.select(
        "instrument_id", "date", F.col("bar.volume").alias("volume"), overlap.alias("overlap"), brokers.bar_main_net(F.col("entries"), top).alias("main_net"),
        pct_simple(close, F.col("prev.close")).alias("ret_same"), F.when(close > 0, ratio(F.col("next.close") - close, close) * 100).alias("ret_next"),
    ).filter("ret_same is not null AND ret_next is not null AND volume > 0").select(
        "instrument_id", "date", (ratio("overlap", "volume") * 100).alias("pressure"), "main_net", "ret_same", "ret_next",
    )


def factor_buckets(panel: DataFrame, factor: str, outcome: str, bins: int = 5, keys: Sequence[str] = ("instrument_id", "date")) -> DataFrame:
    """Equal-count groups of the factor: size, factor median, mean outcome, share below zero.

    Where equal values make edges fall together, the rank is binned instead, equal values
    in the order of ``keys``.  The narrow input is computed once.
    """
    known = panel.filter(F.col(outcome).isNotNull() & F.col(factor).isNotNull()).select(*keys, factor, outcome)
    rows = cut_lineage(known, "factor")
    edges = exact_quantiles(rows, factor, [i / bins for i in range(bins + 1)]).select("q").first()
    if edges and len(set(edges.q)) > bins:
        placed = rows.withColumn("bin", (F.size(F.filter(F.array(*map(F.lit, edges.q[1:-1])), lambda e: e < F.col(factor))) + 1).cast("int"))
    else:
        placed = rank_bins(rows, bins, factor, *keys)
    stats = placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(factor).alias("factor_mean"), F.avg(outcome).alias("outcome_mean"),
        (F.avg((F.col(outcome) < 0).cast("double")) * 100).alias("below_zero_pct"),
    )
    medians = exact_median(placed, factor, ["bin"]).withColumnRenamed("median", "factor_median")
    return stats.join(medians, "bin")


def factor_correlations(panel: DataFrame, factors: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Pearson correlation of every factor with every outcome, in one pass."""
    cells = [F.corr(f, o).alias(f"{f}|{o}") for f in factors for o in outcomes]
    row = panel.agg(F.count(F.lit(1)).alias("n"), *cells)
    pairs = F.array(*[
        F.struct(F.lit(f).alias("factor"), F.lit(o).alias("outcome"), F.col(f"`{f}|{o}`").alias("corr")) for f in factors for o in outcomes
    ])
    return row.select("n", F.inline(pairs))


def threshold_buckets(panel: DataFrame, factor: str, outcome: str, thresholds: Sequence[float], min_size: int = 20) -> DataFrame:
    """Outcome of the rows at or above each threshold; small groups are left out."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    hit = panel.withColumn("threshold", F.explode(F.filter(marks, lambda t: F.col(factor) >= t)))
    return hit.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("outcome_mean"),
        (F.avg((F.col(outcome) < 0).cast("double")) * 100).alias("below_zero_pct"),
    ).filter(F.col("n") >= min_size)


def mask_groups(panel: DataFrame, masks: dict[str, Column], outcomes: Sequence[str], min_size: int = 8) -> DataFrame:
    """Outcome means of named, overlapping groups in one pass."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in masks.items()]))
    aggs = []
    for o in outcomes:
        aggs += [F.avg(o).alias(f"{o}_mean"), (F.avg((F.col(o) < 0).cast("double")) * 100).alias(f"{o}_below_zero_pct")]
    return panel.withColumn("mask", F.explode(names)).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), *aggs).filter(F.col("n") >= min_size)


def upper_tail(panel: DataFrame, factor: str, prob: float = 0.8) -> DataFrame:
    """Rows whose factor is at or above its own quantile."""
    q = exact_quantiles(panel, factor, [prob]).select(F.col("q")[0].alias("__cut"))
    return with_scalar(panel, q, "__cut").filter(F.col(factor) >= F.col("__cut")).drop("__cut")


def liquid_universe(price: DataFrame, n: int, min_close: float = 10.0) -> DataFrame:
    """The n instruments of highest average volume whose last close clears the floor."""
    s = price.groupBy("instrument_id").agg(F.max_by("close", "date").alias("close"), F.avg("volume").alias("avg_volume"))
    return s.filter(F.col("close") >= min_close).orderBy(F.col("avg_volume").desc(), "instrument_id").limit(n)


def volatile_universe(
    price: DataFrame, calendar: DataFrame, window: int, k: int, min_volume: float = 3000, min_close: float = 10, max_close: float = 600,
    coverage: float = 0.7,
) -> DataFrame:
    """The k instruments of highest deviation of returns times log turnover, within bounds."""
    w = ordered("instrument_id")
    r = on_last_dates(price, calendar, window).withColumn("r", pct_simple("close", F.lag("close").over(w)))
    s = r.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("close", "date").alias("close"), F.avg("volume").alias("avg_volume"),
        F.stddev_samp("r").alias("sd"), F.avg(F.col("close") * F.col("volume")).alias("amount"),
    ).filter(
        (F.col("rows") >= window * coverage) & (F.col("avg_volume") > min_volume) & (F.col("close") > min_close)
        & (F.col("close") < max_close) & F.col("sd").isNotNull()
    )
    scored = s.withColumn("score", F.col("sd") * F.log("amount"))
    return scored.orderBy(F.round("score", 6).desc(), "instrument_id").limit(k).select("instrument_id", "close", "avg_volume", "sd", "score")


def pit_pressure_study(study: DataFrame, expected: DataFrame) -> DataFrame:
    """Lock study rows with the point-in-time expected pressure of their date."""
    return enrich(study, expected.select("instrument_id", "date", "expected_pct", "n_flippers"), ["instrument_id", "date"]).filter(
        "expected_pct is not null AND oc is not null"
    )
