"""Trend position, risk levels and timelines from bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOT_SHARES
from ..functions.columns import half_up, ratio
from ..functions.windows import diff, newest_first, ordered, rows_back, sma, top_rows, true_range
from ..session import cut_lineage

YEAR_ROWS, HALF_YEAR_ROWS = 240, 120


def tech_signals(price: DataFrame) -> DataFrame:
    """Alignment of means, place against the 60/240/120-row means, bias, yearly range, turnover.

    Only the newest 240 rows of an instrument are kept, then aggregated once.
    """
    rows = top_rows(price.select("instrument_id", "date", "close", "volume"), newest_first("instrument_id"), YEAR_ROWS)

    def mean(n: int):
        value = F.avg(F.when(F.col("rank") <= n, F.col("close")))
        return F.when(F.count(F.when(F.col("rank") <= n, 1)) == n, value).alias(f"ma{n}")

    s = rows.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max("close").alias("hi"), F.min("close").alias("lo"),
        F.max_by("close", "date").alias("c"), F.max_by("volume", "date").alias("v"),
        *[mean(n) for n in (5, 10, 20, 60, 120, 240)],
    )
    c, ma5, ma10, ma20 = F.col("c"), F.col("ma5"), F.col("ma10"), F.col("ma20")
    align = (
        F.when(ma20.isNull(), "-").when((ma5 > ma10) & (ma10 > ma20), "bull")
        .when((ma5 < ma10) & (ma10 < ma20), "bear").otherwise("mixed")
    )
    up60, up240 = c > F.col("ma60"), c > F.col("ma240")
    long_term = (
        F.when(F.col("ma60").isNull(), "-")
        .when(F.col("ma240").isNull(), F.when(up60, "above season").otherwise("below season"))
        .when(up60 & up240, "above both").when(up60, "above season").when(up240, "above year").otherwise("below both")
    )
    half = F.when(F.col("ma120").isNull(), "-").when(c > F.col("ma120"), "above half year").otherwise("below half year")
    position = F.when(
        (F.col("rows") >= HALF_YEAR_ROWS) & (F.col("hi") > F.col("lo")), ratio(c - F.col("lo"), F.col("hi") - F.col("lo")) * 100
    )
    return s.select(
        "instrument_id", align.alias("ma_align"), long_term.alias("long_term"), half.alias("half_year"),
        F.when(ma20 > 0, ratio(c - ma20, ma20) * 100).alias("bias20_pct"),
        position.alias("year_position_pct"), (c * F.col("v") / 1e5).alias("turnover"),
    )


def risk_levels(price: DataFrame, atr_mult: float = 2.0, target_r: float = 2.0, period: int = 14) -> DataFrame:
    """Mean true range of the last rows, stop and target around the newest close.

    A stop at or below zero is null, and with it the stop distance and the target.
    """
    rows = top_rows(
        price.withColumn("tr", true_range(ordered("instrument_id"))).select("instrument_id", "date", "close", "tr"),
        newest_first("instrument_id"), period,
    )
    s = rows.groupBy("instrument_id").agg(
        F.count("tr").alias("n"), F.avg("tr").alias("atr"), F.max_by("close", "date").alias("close")
    ).filter((F.col("n") >= period) & (F.col("atr") > 0))
    raw = F.col("close") - F.col("atr") * atr_mult
    s = s.withColumn("stop", F.when(raw > 0, raw))
    risk = F.col("close") - F.col("stop")
    return s.select(
        "instrument_id", "close", "atr", "stop",
        (ratio(-risk, "close") * 100).alias("stop_pct"),
        (F.col("close") + risk * target_r).alias("target"),
    )


def position_sizing(
    requests: DataFrame, levels: DataFrame, risk_pct: float = 1.0, max_position_pct: float = 25.0,
    atr_mult: float = 2.0, target_r: float = 2.0,
) -> DataFrame:
    """Lots for every (account_id, instrument_id, account): by risk per share, capped by position size.

    Every request is answered; where it cannot be sized, ``note`` says why.
    """
    # one row an instrument; stored, its size decides how it meets the requests
    levels = cut_lineage(levels.select("instrument_id", "close", "atr"), "levels")
    joined = requests.join(levels.select("instrument_id", F.col("close").alias("entry"), "atr"), "instrument_id", "left")
    stop = F.round(F.col("entry") - half_up("atr", 2) * atr_mult, 2)
    s = joined.withColumn("stop", stop).withColumn("risk", F.col("entry") - F.col("stop"))
    sound = F.col("risk") > 0
    by_risk = F.when(sound, F.floor(F.floor(F.col("account") * risk_pct / 100 / F.col("risk")) / LOT_SHARES))
    by_size = F.when(sound, F.floor(F.col("account") * max_position_pct / 100 / (F.col("entry") * LOT_SHARES)))
    s = s.withColumn("by_risk", by_risk).withColumn("by_size", by_size)
    lots = F.when(F.col("by_risk").isNotNull() & F.col("by_size").isNotNull(), F.least("by_risk", "by_size"))
    shares = lots * LOT_SHARES
    fits = lots >= 1
    return s.select(
        "account_id", "instrument_id", "entry", "stop",
        F.when(fits, lots).alias("lots"),
        F.when(fits, F.col("entry") + F.col("risk") * target_r).alias("target"),
        F.when(fits, shares * F.col("entry")).alias("position_value"),
        F.when(fits, shares * F.col("risk")).alias("risk_amount"),
        F.when(fits, ratio(shares * F.col("risk"), F.col("account")) * 100).alias("risk_of_account_pct"),
        (F.col("by_risk") > F.col("by_size")).alias("capped"),
        F.when(F.col("entry").isNull(), "too few bars for a range").when(F.col("risk") <= 0, "no distance to the stop")
        .when(F.col("account").isNull(), "no balance").when(~fits, "less than one lot").alias("note"),
    )


def ma_series(price: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Close with its 5, 20 and 60 row means; the last rows of each instrument if asked."""
    w = ordered("instrument_id")
    out = price.select("instrument_id", "date", "close", *[sma("close", w, n).alias(f"ma{n}") for n in (5, 20, 60)])
    return top_rows(out, newest_first("instrument_id"), n_rows).drop("rank") if n_rows else out


def chip_timeline(price: DataFrame, inst: DataFrame, margin: DataFrame, sbl: DataFrame, n_rows: int = 30) -> DataFrame:
    """Close, change, flows and balance changes, the last rows of every instrument.

    Balances change against their own table's previous row.
    """
    w = ordered("instrument_id")
    key = ["instrument_id", "date"]
    px = price.select(*key, "close", "volume", (ratio(diff("close", w), rows_back("close", w)) * 100).alias("change_pct"))
    m = margin.select(*key, diff("margin_balance", w).alias("margin_change"), diff("short_balance", w).alias("short_change"))
    s = sbl.select(*key, "sbl_balance", diff("sbl_balance", w).alias("sbl_change"))
    joined = (
        px.join(inst.select(*key, "foreign_net", "trust_net", "dealer_net"), key, "left")
        .join(m, key, "left").join(s, key, "left")
    )
    return top_rows(joined, newest_first("instrument_id"), n_rows).drop("rank")


def day_trade_timeline(timeline: DataFrame, day_trade: DataFrame) -> DataFrame:
    """Day-trade share along a timeline."""
    return timeline.join(day_trade, ["instrument_id", "date"]).filter("volume > 0").select(
        "instrument_id", "date", (ratio("dt_vol", "volume") * 100).alias("day_trade_pct")
    )


def index_change(index: DataFrame, key: str = "symbol") -> DataFrame:
    """Newest value of each outside index, its change and a five-way label."""
    two = top_rows(index, newest_first(key), 2)
    s = two.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("close", "date").alias("price"), F.min_by("close", "date").alias("prev")
    ).filter("n = 2 AND prev <> 0")
    s = s.withColumn("change_pct", F.round(ratio(F.col("price") - F.col("prev"), F.col("prev")) * 100, 2))
    c = F.col("change_pct")
    label = (
        F.when(c <= -3, "plunge").when(c <= -1, "weak").when(c >= 3, "surge").when(c >= 1, "firm").otherwise("flat")
    )
    return s.select(key, "price", "prev", "change_pct", label.alias("label"))
