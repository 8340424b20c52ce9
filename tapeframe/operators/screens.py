"""As-of screens: one row per instrument that passes at the newest date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    Accumulation,
    DayTrade,
    LockScreen,
    MainForce,
    RelativeStrength,
    RevenueMomentum,
    Value,
)
from ..functions.columns import clip, contains_any, pct_simple, ratio, vote
from ..functions.quantiles import exact_median, with_scalar
from ..functions.windows import latest_streaks, newest_first, ordered, top_rows
from ..session import cut_lineage
from ..sources.calendar import Days, on_last_dates
from .joins import enrich
from .signals import revenue_gate, revenue_score




def _liquid(avg: str, floor: float, floor_tpex: float) -> Column:
    return F.col(avg) >= F.when(F.col("type") == "tpex", floor_tpex).otherwise(floor)


def last_rows_mean(bars: DataFrame, n: int, c: str = "close") -> DataFrame:
    """(instrument_id, ma, last_close, avg_volume): newest n rows per instrument; ma needs all n."""
    rows = top_rows(bars.select("instrument_id", "date", c, "volume"), newest_first("instrument_id"), n)
    return rows.groupBy("instrument_id").agg(
        F.when(F.count(F.lit(1)) >= n, F.avg(c)).alias("ma"),
        F.max_by(c, "date").alias("last_close"),
        F.avg("volume").alias("avg_volume"),
    )


def accumulation_screen(
    price: DataFrame, inst: DataFrame, margin: DataFrame, info: DataFrame,
    p: Accumulation = Accumulation(), min_streak: int | None = None,
) -> DataFrame:
    """Quiet institutional buying as of the newest date that every market has reported.

    The price window is the last dates of the investor table; the margin change runs
    over the whole margin history.  A smaller ``min_streak`` gives a superset.
    """
    need = p.min_streak if min_streak is None else min_streak
    flows = inst.join(info.select("instrument_id", "type"), "instrument_id", "left")
    asof = flows.groupBy("type").agg(F.max("date").alias("d")).agg(F.min("d").alias("d")).select("d").scalar()
    dates = inst.filter(F.col("date") <= asof).select("date").distinct()
    dates = dates.orderBy(F.col("date").desc()).limit(p.lookback)
    oldest = dates.agg(F.min("date").alias("d")).select("d").scalar()

    window = price.filter(F.col("date") >= oldest).join(F.broadcast(dates), "date", "left_semi").groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("volume").alias("avg_volume"),
        F.sum("volume").alias("total_volume"),
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("close"),
    )
    net = F.when(F.col("type") == "tpex", F.col("foreign_net")).otherwise(F.col("trust_net"))
    chosen = flows.filter(F.col("date") >= oldest).withColumn("net", net).join(F.broadcast(dates), "date", "left_semi")
    streak = latest_streaks(chosen, "instrument_id", {"net": "streak"})
    bought = chosen.groupBy("instrument_id").agg(F.sum("net").alias("cum_net"))
    balances = margin.groupBy("instrument_id").agg(
        F.min_by("margin_balance", "date").alias("m0"),
        F.max_by("margin_balance", "date").alias("m1"),
        F.count(F.lit(1)).alias("mn"),
    )
    ma = last_rows_mean(price.filter(F.col("date") <= asof), 20).select("instrument_id", "ma")
    first, last = F.col("first_close"), F.col("close")
    joined = (
        window.filter((F.col("rows") >= p.lookback - p.allowed_missing) & (first > 0))
        .join(info, "instrument_id", "left")
        .filter(_liquid("avg_volume", p.min_avg_volume, p.min_avg_volume_tpex))
        .withColumn("gain", ratio(last - first, first))
        .filter((F.col("gain") < p.max_gain) & (F.col("gain") >= p.min_gain))
        .join(streak.filter(F.col("streak") >= need), "instrument_id")
        .join(bought, "instrument_id")
        .join(balances, "instrument_id", "left")
        .join(ma, "instrument_id", "left")
    )
    change = F.when(
        (F.col("mn") >= 2) & (F.col("m0") != 0), ratio(F.col("m1") - F.col("m0"), F.abs("m0"))
    ).otherwise(0.0)
    buy_ratio = F.when(F.col("total_volume") > 0, ratio("cum_net", "total_volume")).otherwise(0.0)
    near = F.col("ma").isNull() | (F.col("ma") <= 0) | (ratio(last - F.col("ma"), F.col("ma")) <= p.max_above_ma20)
    return (
        joined.withColumn("buy_ratio", buy_ratio).withColumn("margin_change", change)
        .filter((F.col("buy_ratio") >= p.min_buy_ratio) & (F.col("margin_change") <= p.max_margin_increase) & near)
        .select(
            "instrument_id", "instrument_name", F.col("type").alias("market"),
            F.when(F.col("type") == "tpex", "foreign").otherwise("trust").alias("investor"),
            asof.alias("asof_date"), "close",
            (F.col("gain") * 100).alias("gain_pct"), "streak", "cum_net",
            (F.col("buy_ratio") * 100).alias("buy_ratio_pct"),
            (F.col("margin_change") * 100).alias("margin_change_pct"), "avg_volume",
            (F.col("buy_ratio") * 200 + F.col("streak") * 3 + F.col("gain") * 100).alias("score"),
        )
    )


def relative_strength_screen(
    price: DataFrame, info: DataFrame, calendar: DataFrame | Days, p: RelativeStrength = RelativeStrength()
) -> DataFrame:
    """Window return against the market median, over the last global dates."""
    rets = (
        on_last_dates(price, calendar, p.lookback)
        .groupBy("instrument_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min_by("close", "date").alias("c0"), F.max_by("close", "date").alias("c1"),
            F.avg("volume").alias("avg_volume"),
        )
        .filter((F.col("rows") >= p.lookback - 1) & (F.col("c0") > 0))
        .withColumn("ret", ratio(F.col("c1") - F.col("c0"), F.col("c0")))
    )
    market = exact_median(rets, "ret")
    out = with_scalar(rets.filter(F.col("ret").between(p.min_return, p.max_return)), market, "median")
    return (
        out.join(info, "instrument_id", "left")
        .filter(_liquid("avg_volume", p.min_avg_volume, p.min_avg_volume_tpex))
        .select(
            "instrument_id", "instrument_name", F.col("type").alias("market"),
            (F.col("ret") * 100).alias("return_pct"),
            ((F.col("ret") - F.col("median")) * 100).alias("vs_market_pct"), "avg_volume",
        )
    )


def revenue_momentum_screen(
    latest_revenue: DataFrame, price: DataFrame, info: DataFrame, p: RevenueMomentum = RevenueMomentum()
) -> DataFrame:
    """Growing and accelerating revenue, confirmed by price; scores are capped."""
    ctx = last_rows_mean(price, 20)
    above = F.coalesce(F.col("last_close") >= F.col("ma"), F.lit(False))
    return (
        latest_revenue.filter(revenue_gate(p))
        .join(info, "instrument_id", "left")
        .filter(~contains_any("industry", p.exclude_industries))
        .join(ctx, "instrument_id")
        .filter((F.col("last_close") >= p.min_close) & (F.col("avg_volume") >= p.min_avg_volume))
        .select(
            "instrument_id", "instrument_name", F.col("type").alias("market"), "industry",
            F.col("last_close").alias("close"), "ym", "yoy", "cum_yoy", "mom",
            (F.col("yoy") - F.col("cum_yoy")).alias("acceleration"), above.alias("above_ma20"),
            (revenue_score(p) + F.when(above, p.ma_bonus).otherwise(0.0)).alias("score"),
        )
    )


def value_screen(
    valuation: DataFrame, dividend_years: DataFrame, revenue_yoy: DataFrame, eps_growth: DataFrame,
    info: DataFrame, p: Value = Value(),
) -> DataFrame:
    """Two stages: cheap filters and a short list, then dividends and growth.

    The short list is the feature: it keeps the ``shortlist`` best by yield per
    earnings multiple.  At most ``max_lumpy`` names of lumpy industries remain.
    """
    roe = ratio("pbr", "per") * 100
    coarse = (
        valuation.filter(
            (F.col("yield") >= p.min_yield) & (F.col("per") > 0) & (F.col("per") <= p.max_per)
            & (F.col("pbr") > 0) & (F.col("pbr") <= p.max_pbr)
        )
        .withColumn("roe_est", F.round(roe, 1))
        .filter(roe >= p.min_roe)
        .withColumn("rank_key", ratio("yield", F.greatest(F.col("per"), F.lit(1.0))))
        .orderBy(F.col("rank_key").desc(), "instrument_id")
        .limit(p.shortlist)
    )
    lumpy = contains_any("industry", p.lumpy_industries)
    yoy_part = F.when(F.col("lumpy"), 0.0).otherwise(
        clip(F.coalesce(F.col("last_yoy"), F.lit(0.0)), -30, 50) * 0.4
    )
    eps_part = clip(F.coalesce(F.col("eps_growth"), F.lit(0.0)), -30, 60) * 0.3
    scored = (
        coarse.join(dividend_years, "instrument_id", "left")
        .filter(F.col("dividend_years") >= p.min_dividend_years)
        .join(revenue_yoy, "instrument_id", "left").join(eps_growth, "instrument_id", "left")
        .join(info, "instrument_id", "left").withColumn("lumpy", lumpy)
        .withColumn(
            "score",
            F.col("yield") * 3 + F.lit(100.0) / F.greatest(F.col("per"), F.lit(1.0)) + F.col("roe_est") * 1.5
            + yoy_part + eps_part + F.least(F.col("dividend_years"), F.lit(20)) * 1.5,
        )
    )
    return capped_category(scored, "lumpy", "score", p.max_lumpy).select(
        "instrument_id", "instrument_name", "industry", "yield", "per", "pbr", "roe_est", "last_yoy",
        "eps_ttm", "eps_growth", "dividend_years", "lumpy", "score",
    )


def capped_category(df: DataFrame, flag: str, score: str, cap: int) -> DataFrame:
    """All rows without the flag, the best ``cap`` rows with it; ``df`` is computed once."""
    df = cut_lineage(df, "capped")
    best = df.filter(flag).orderBy(F.col(score).desc(), "instrument_id").limit(cap)
    return df.filter(~F.col(flag)).unionByName(best)


def day_trade_candidates(
    price: DataFrame, info: DataFrame, calendar: DataFrame | Days, p: DayTrade = DayTrade()
) -> DataFrame:
    """Liquid instruments with wide daily ranges over the last global dates."""
    w = ordered("instrument_id")
    prev = F.lag("close").over(w)
    window = on_last_dates(price, calendar, p.lookback).withColumn(
        "amp", F.when(prev > 0, ratio(F.col("high") - F.col("low"), prev) * 100)
    )
    stats = window.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("volume").alias("avg_volume"),
        F.avg("amp").alias("avg_amp"),
        F.max_by(F.struct("close", "amp", "volume"), "date").alias("last"),
    )
    surge = F.when(F.col("avg_volume") > 0, ratio("last.volume", "avg_volume")).otherwise(0.0)
    return (
        stats.filter((F.col("rows") >= p.min_rows) & (F.col("avg_amp") >= p.min_avg_amplitude))
        .join(info, "instrument_id", "left")
        .filter(_liquid("avg_volume", p.min_avg_volume, p.min_avg_volume_tpex))
        .withColumn("surge", surge)
        .select(
            "instrument_id", "instrument_name", F.col("type").alias("market"), F.col("last.close").alias("close"),
            F.col("last.amp").alias("amp_today"), "avg_amp", "surge", "avg_volume",
            (
                F.col("avg_amp") * F.log10(F.greatest(F.floor("avg_volume"), F.lit(10)))
                + F.greatest(F.col("surge") - 1, F.lit(0.0)) * 5
            ).alias("score"),
        )
    )


def main_force_score(
    price: DataFrame, inst: DataFrame, margin: DataFrame, holders: DataFrame, info: DataFrame,
    calendar: DataFrame | Days, p: MainForce = MainForce(),
) -> DataFrame:
    """Institutional share of volume, big-holder change and margin retreat in one score."""
    bars = on_last_dates(price, calendar, p.lookback).groupBy("instrument_id").agg(
        F.max_by("close", "date").alias("close"), F.avg("volume").alias("avg_volume"), F.sum("volume").alias("vol")
    )
    flows = on_last_dates(inst, calendar, p.lookback).groupBy("instrument_id").agg(
        F.sum(F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net")).alias("inst_net")
    )
    balances = margin.groupBy("instrument_id").agg(
        F.min_by("margin_balance", "date").alias("m0"), F.max_by("margin_balance", "date").alias("m1"),
        F.count(F.lit(1)).alias("mn"),
    )
    margin_pct = F.when((F.col("mn") >= 2) & (F.col("m0") > 0), ratio(F.col("m1") - F.col("m0"), F.col("m0")) * 100)
    return (
        bars.filter((F.col("close") >= p.min_close) & (F.col("avg_volume") >= p.min_avg_volume) & (F.col("vol") > 0))
        .join(flows, "instrument_id", "left").join(holders, "instrument_id", "left").join(balances, "instrument_id", "left")
        .join(info, "instrument_id", "left")
        .withColumn("inst_net", F.coalesce("inst_net", F.lit(0.0)))
        .withColumn("inst_pct", ratio("inst_net", "vol") * 100)
        .withColumn("margin_change_pct", F.coalesce(margin_pct, F.lit(0.0)))
        .select(
            "instrument_id", "instrument_name", F.col("type").alias("market"), "close", "inst_net", "inst_pct",
            "holder_pct", "holder_change", "margin_change_pct",
            (
                F.col("inst_pct") * p.w_inst
                + F.coalesce("holder_change", F.lit(0.0)) * p.w_holder
                - F.col("margin_change_pct") * p.w_margin
            ).alias("score"),
        )
    )


def day_trade_bias(
    candidates: DataFrame, force: DataFrame, price: DataFrame, regime_direction: int, lookback: int = 20
) -> DataFrame:
    """Five one-vote checks per candidate; its tag at two votes, with or against the market.

    The return base is the oldest of the last ``lookback`` rows.
    """
    rows = top_rows(price.select("instrument_id", "date", "close"), newest_first("instrument_id"), lookback)
    ctx = rows.groupBy("instrument_id").agg(
        F.min_by("close", "date").alias("c0"), F.max_by("close", "date").alias("c1"),
        F.avg(F.when(F.col("rank") <= 20, F.col("close"))).alias("mean"),
        F.count(F.when(F.col("rank") <= 20, 1)).alias("n"),
    ).select(
        "instrument_id",
        F.coalesce(ratio(F.col("c1") - F.col("c0"), F.col("c0")) * 100, F.lit(0.0)).alias("ret"),
        F.when(F.col("n") >= 20, F.col("mean")).alias("ma20"),
    )
    market = exact_median(ctx, "ret")
    picked = with_scalar(enrich(enrich(candidates, ctx), force.select("instrument_id", "inst_pct", "holder_change", "margin_change_pct")), market, "median")
    margin = F.col("margin_change_pct")
    votes = (
        vote("inst_pct", 3, -3) + vote("holder_change", 0.3, -0.3)
        + F.when(margin < -5, 1).when(margin > 15, -1).otherwise(0)
        + vote(F.coalesce(F.col("ret"), F.lit(0.0)) - F.col("median"), 5, -5)
        + F.when(F.col("ma20").isNull(), 0).when(F.col("close") > F.col("ma20"), 1).otherwise(-1)
    )
    direction = F.when(F.col("votes") >= 2, 1).when(F.col("votes") <= -2, -1).otherwise(0)
    out = picked.withColumn("votes", votes).withColumn("direction", direction)
    return out.select(
        *candidates.columns, "votes",
        F.when(F.col("direction") == 1, "bull").when(F.col("direction") == -1, "bear").otherwise("neutral").alias("bias"),
        F.when((F.col("direction") == 0) | (F.lit(regime_direction) == 0), "-")
        .when(F.col("direction") == regime_direction, "with").otherwise("against").alias("alignment"),
    )


def market_breadth(price: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: advances and declines of the newest date, share above the 20-row mean, posture."""
    two = on_last_dates(price.select("instrument_id", "date", "close"), calendar, 2)
    last = calendar.agg(F.max("date").alias("d")).select("d").scalar()
    change = two.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max_by("close", "date") - F.min_by("close", "date")).alias("diff"),
    ).filter("n = 2")
    moves = change.agg(
        F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"),
        F.count_if(F.col("diff") == 0).alias("flat"),
    )
    above = last_rows_mean(price, 20).filter(F.col("ma").isNotNull()).agg(
        F.avg((F.col("last_close") > F.col("ma")).cast("double")).alias("share")
    )
    row = with_scalar(moves, above, "share").withColumn("pct_above_ma20", F.round(F.col("share") * 100, 1))
    up_down = F.when(F.col("down") > 0, ratio("up", "down")).otherwise(999.0)
    posture = (
        F.when((F.col("pct_above_ma20") >= 60) & (up_down > 1), "bull")
        .when(F.col("pct_above_ma20") <= 30, "bear")
        .when(up_down >= 2, "broad up").when(up_down <= 0.5, "broad down").otherwise("neutral")
    )
    return row.select(last.alias("date"), "up", "down", "flat", "pct_above_ma20", posture.alias("posture"))


# Lower bound of the share above the mean, label, exposure, advice.
REGIME_LEVELS = (
    (60, "bull", "70-100%", "select actively"),
    (45, "mildly bull", "40-60%", "be strict, control size"),
    (30, "weak range", "20-30%", "strongest only, tight stops"),
    (0, "bear", "0-20%", "mostly cash"),
)


def regime_level(breadth: DataFrame) -> DataFrame:
    """Breadth row with regime label, suggested exposure and advice."""
    share = F.col("pct_above_ma20")

    def pick(i: int) -> Column:
        out = F.when(share.isNull(), F.lit("not enough data"))
        for level in REGIME_LEVELS:
            out = out.when(share >= level[0], level[i])
        return out.otherwise(REGIME_LEVELS[-1][i])

    return breadth.withColumns(
        {"regime": pick(1), "suggested_exposure": pick(2), "advice": pick(3)}
    )


def limit_up_candidates(price: DataFrame, calendar: DataFrame, p: LockScreen = LockScreen(), every_date: bool = False) -> DataFrame:
    """Instruments up ``min_gain`` percent on the previous date, the most traded ``top_n`` of the day.

    With ``every_date`` the same rule runs for each date of the panel.
    """
    w = ordered("instrument_id")
    dates = calendar if every_date else calendar.filter("age = 1")
    prev_close, prev_date = F.lag("close").over(w), F.lag("date").over(w)
    src = price.select("instrument_id", "date", "open", "close", "volume")
    if not every_date:
        src = on_last_dates(src, calendar, 2)
    moved = (
        src.withColumn("prev_close", prev_close).withColumn("seen", prev_date)
        .join(dates.select("date", "prev_date"), "date")
        .filter((F.col("seen") == F.col("prev_date")) & (F.col("prev_close") > 0) & (F.col("volume") > 0))
        .withColumn("change_pct", pct_simple("close", "prev_close"))
        .filter(F.col("change_pct") >= p.min_gain)
        .withColumn("turnover", F.col("close") * F.col("volume") / 1e5)
    )
    rank = Window.partitionBy("date").orderBy(F.col("turnover").desc(), "instrument_id")
    return top_rows(moved, rank, p.top_n).select(
        "date", "prev_date", "instrument_id", "open", "close", "volume", "change_pct", "turnover", "rank"
    )
