"""Point-in-time signals: every row sees only its own past.

All functions return (date, instrument_id, score, ...) for every date at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Accumulation, QuietAccumulation, RelativeStrength, RevenueMomentum, Value
from ..functions.columns import clip, ratio
from ..functions.quantiles import exact_median
from ..functions.windows import buy_streak, ordered, return_n, row_index, sma, trailing, with_sliding_range
from ..session import cut_lineage
from .joins import asof_join


def relative_strength_returns(bars: DataFrame, lookback: int, vol_window: int = 20) -> DataFrame:
    """(instrument_id, date, ret, sigma): trailing return and deviation of row returns."""
    w = ordered("instrument_id")
    step = bars.select(
        "instrument_id", "date", "close",
        return_n("close", w, lookback).alias("ret"),
        F.coalesce(return_n("close", w, 1), F.lit(0.0)).alias("r1"),
        row_index(w).alias("i"),
    )
    sigma = F.when(
        F.col("i") >= max(lookback, vol_window), F.stddev_pop("r1").over(trailing(w, vol_window))
    )
    return step.withColumn("sigma", sigma).filter(F.col("ret").isNotNull())


def relative_strength_signals(
    bars: DataFrame, params: RelativeStrength = RelativeStrength(), rank: str = "rs", vol_window: int = 20
) -> DataFrame:
    """Trailing return minus the median of all instruments on that date.

    ``rank``: "rs" the excess itself, "lowvol" the negative deviation, "riskadj" the
    excess per unit of deviation.  Rows without a positive deviation drop out of the
    last two.
    """
    # four narrow columns, stored once for the median and the band
    rets = cut_lineage(relative_strength_returns(bars, params.lookback, vol_window).select("date", "instrument_id", "ret", "sigma"), "returns")
    med = exact_median(rets, "ret", ["date"])
    banded = rets.filter(F.col("ret").between(params.min_return, params.max_return))
    excess = F.col("ret") - F.col("median")
    out = banded.join(F.broadcast(med), "date")  # one row per trading date
    if rank == "rs":
        score = excess
    else:
        out = out.filter(F.col("sigma") > 0)
        score = -F.col("sigma") if rank == "lowvol" else ratio(excess, F.col("sigma"))
    return out.select("date", "instrument_id", "ret", F.col("median").alias("market_ret"), score.alias("score"))


def accumulation_features(panel: DataFrame, lookback: int) -> DataFrame:
    """Trailing-window measures the accumulation gates compare, for every row."""
    w = ordered("instrument_id")
    frame = trailing(w, lookback)
    first = F.first("close").over(frame)
    margin = F.col("margin_balance")
    m_first = F.first(margin, ignorenulls=True).over(frame)
    m_last = F.last(margin, ignorenulls=True).over(frame)
    net, vol = F.sum("inst_net").over(frame), F.sum("volume").over(frame)
    ma20 = sma("close", w, 20)
    return panel.select(
        "instrument_id", "date", "close",
        F.count(F.lit(1)).over(frame).alias("rows"),
        F.when(first > 0, ratio(F.col("close") - first, first)).alias("gain"),
        buy_streak("inst_net", w).alias("streak"),
        F.when(vol > 0, ratio(net, vol)).otherwise(0.0).alias("buy_ratio"),
        F.when(
            (F.count(margin).over(frame) >= 2) & (m_first != 0), ratio(m_last - m_first, F.abs(m_first))
        ).alias("margin_increase"),
        F.when(ma20 > 0, ratio(F.col("close") - ma20, ma20)).alias("above_ma20"),
        F.sum(F.when(F.col("inst_net") > 0, 1).otherwise(0)).over(frame).alias("buy_days"),
    )


def accumulation_gates(features: DataFrame, p: Accumulation | None = None, cfg: str | None = None) -> DataFrame:
    """Rows that pass every gate; thresholds from ``p`` or from the struct column ``cfg``."""

    def t(name: str):
        return F.col(f"{cfg}.{name}") if cfg else F.lit(getattr(p, name))

    ok = (
        (F.col("rows") >= t("lookback") - t("allowed_missing"))
        & (F.col("gain") >= t("min_gain")) & (F.col("gain") < t("max_gain"))
        & (F.least(F.col("streak"), F.col("rows")) >= t("min_streak"))
        & (F.col("buy_ratio") >= t("min_buy_ratio"))
        & (F.col("margin_increase").isNull() | (F.col("margin_increase") <= t("max_margin_increase")))
        & (F.col("above_ma20").isNull() | (F.col("above_ma20") <= t("max_above_ma20")))
    )
    return features.filter(ok)


def accumulation_signals(panel: DataFrame, params: Accumulation = Accumulation()) -> DataFrame:
    """Steady institutional buying before the price moves, for every date.

    The score counts positive days of the window, not the streak.
    """
    passed = accumulation_gates(accumulation_features(panel, params.lookback), params)
    return passed.select(
        "date", "instrument_id", "gain", "streak", "buy_ratio",
        (F.col("buy_days") * 3 + F.col("buy_ratio") * 100 * 2).alias("score"),
    )


def quiet_accumulation_signals(panel: DataFrame, p: QuietAccumulation = QuietAccumulation()) -> DataFrame:
    """Persistent buying while the price rests: flat, near its mean, on thin volume."""
    w = ordered("instrument_id")
    win = trailing(w, p.window)
    panel = with_sliding_range(panel, "close", p.year_rows, "__hi", "__lo")
    vol = F.sum("volume").over(win)
    start = F.lag("close", p.window - 1).over(w)
    hi, lo = F.col("__hi"), F.col("__lo")
    v60 = F.avg("volume").over(trailing(w, 60))
    f = panel.select(
        "instrument_id", "date", "close",
        row_index(w).alias("i"),
        F.when(vol > 0, ratio(F.sum("inst_net").over(win), vol)).alias("buy_ratio"),
        F.sum(F.when(F.col("inst_net") > 0, 1).otherwise(0)).over(win).alias("buy_days"),
        F.when(start > 0, ratio("close", start) - 1).alias("ret"),
        F.avg("close").over(trailing(w, 20)).alias("ma20"),
        F.when(v60 > 0, ratio(F.avg("volume").over(trailing(w, 10)), v60)).alias("squeeze"),
        F.when(hi > lo, ratio(F.col("close") - lo, hi - lo) * 100).alias("position"),
    )
    ok = (
        (F.col("i") >= p.year_rows)
        & (F.col("buy_ratio") >= p.buy_ratio)
        & (F.col("buy_days") >= p.min_days)
        & F.col("ret").between(p.min_return, p.max_return)
        & (F.col("ma20") > 0) & (F.abs(ratio("close", "ma20") - 1) <= p.ma_dev)
        & (F.col("squeeze") <= p.volume_squeeze)
        & (F.col("position").isNull() | (F.col("position") <= p.max_position))
    )
    return f.filter(ok).select("date", "instrument_id", "ret", "squeeze", "position", F.col("buy_ratio").alias("score"))


def revenue_gate(p: RevenueMomentum):
    """Growth in both bands and accelerating."""
    return (
        F.col("yoy").between(p.min_yoy, p.max_yoy)
        & F.col("cum_yoy").between(p.min_cum, p.max_cum)
        & (F.col("yoy") - F.col("cum_yoy") >= p.min_accel)
    )


def revenue_score(p: RevenueMomentum):
    return (
        clip("yoy", hi=p.cap_yoy)
        + clip("cum_yoy", hi=p.cap_cum) * 0.5
        + clip(F.col("yoy") - F.col("cum_yoy"), hi=p.cap_accel)
    )


def revenue_momentum_signals(
    bars: DataFrame, revenue_panel: DataFrame, p: RevenueMomentum = RevenueMomentum()
) -> DataFrame:
    """Every trading date with the newest revenue published by then.

    Several months published on one day: the latest month counts.
    """
    known = asof_join(
        bars.select("instrument_id", "date"),
        revenue_panel.select("instrument_id", "pub_date", "ym", "yoy", "cum_yoy"),
        "date", "pub_date", tie_break=["ym"],
    )
    return known.filter(revenue_gate(p)).select(
        "date", "instrument_id", "ym", "pub_date", "yoy", "cum_yoy", revenue_score(p).alias("score")
    )


def value_signals(valuation: DataFrame, universe: DataFrame, p: Value = Value()) -> DataFrame:
    """Monthly value screen over instruments that have bars."""
    roe = ratio("pbr", "per") * 100
    ok = (
        (F.col("yield") >= p.min_yield)
        & (F.col("per") > 0) & (F.col("per") <= p.max_per)
        & (F.col("pbr") > 0) & (F.col("pbr") <= p.max_pbr)
    )
    cheap = valuation.filter(ok).withColumn("roe_est", roe).filter(F.col("roe_est") >= p.min_roe)
    return cheap.join(universe.select("instrument_id"), "instrument_id", "left_semi").select(
        "date", "instrument_id", "roe_est",
        (F.col("yield") * 3 + F.lit(100.0) / F.greatest(F.col("per"), F.lit(1.0)) + F.col("roe_est") * 1.5).alias("score"),
    )


def regime_gate(bars: DataFrame, calendar: DataFrame, threshold: float = 45.0, ma: int = 20) -> DataFrame:
    """(date, pct_above, regime_ok): share of instruments at or above their mean.

    A date without enough history is open.
    """
    mean = sma("close", ordered("instrument_id"), ma)
    day = (
        bars.select("date", "close", mean.alias("m"))
        .groupBy("date")
        .agg((F.avg((F.col("close") >= F.col("m")).cast("double")) * 100).alias("pct_above"))
    )
    return calendar.select("date").join(day, "date", "left").select(
        "date", "pct_above", F.coalesce(F.col("pct_above") >= threshold, F.lit(True)).alias("regime_ok")
    )


