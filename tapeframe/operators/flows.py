"""Investor flows and balances: streaks, windows, ratios, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOT_SHARES, MAX_STALE_DAYS
from ..functions.columns import ratio, tag_text, tags
from ..functions.windows import latest_streaks, newest_first, top_rows
from ..sources.calendar import Days, on_last_dates

FLOWS = ("foreign_net", "trust_net", "dealer_net")
STRONG_STREAK = 5


def last_two(df: DataFrame, days: Days, *columns: str) -> DataFrame:
    """(instrument_id, c, prev_c …): values on the two newest dates; null where a date is missing."""
    two = on_last_dates(df, days, 2)
    cur = F.col("date") == days.newest()
    aggs = []
    for c in columns:
        aggs += [F.max(F.when(cur, F.col(c))).alias(c), F.max(F.when(~cur, F.col(c))).alias(f"prev_{c}")]
    return two.groupBy("instrument_id").agg(*aggs)


def chip_signals(
    inst: DataFrame, price: DataFrame, margin: DataFrame, calendar: DataFrame | Days,
    streak_dates: int = 30, flow_days: Days | None = None, balance_days: Days | None = None,
) -> DataFrame:
    """Streaks of three investor classes, dominance, volume ratio, margin and short shares, label.

    Flows and balances count by the newest dates of their own tables, which may lag behind the prices.
    """
    days, flow_dates, balance_dates = Days.of(calendar), flow_days or Days.of(inst), balance_days or Days.of(margin)
    streaks = latest_streaks(
        on_last_dates(inst, flow_dates, streak_dates), "instrument_id",
        {"foreign_net": "foreign_streak", "trust_net": "trust_streak", "dealer_net": "dealer_streak"},
    )
    today = on_last_dates(inst, flow_dates, 1).select("instrument_id", "date", *FLOWS)
    today = today.join(
        price.select("instrument_id", "date", F.col("volume").alias("volume_same")), ["instrument_id", "date"], "left"
    ).drop("date")
    volume = on_last_dates(price, days, 20).groupBy("instrument_id").agg(
        F.max(F.when(F.col("date") == days.newest(), F.col("volume"))).alias("volume_today"),
        F.avg("volume").alias("volume_mean"),
    )
    balance = last_two(margin, balance_dates, "margin_balance", "short_balance")
    vol = F.col("volume_today")
    share = lambda c: F.when(vol > 0, ratio(F.col(c) - F.col(f"prev_{c}"), vol) * 100)
    f, t = F.col("foreign_net"), F.col("trust_net")
    flags = [((f > 0) & (t > 0), "both buy"), ((f < 0) & (t < 0), "both sell")]
    for who in ("foreign", "trust", "dealer"):
        s = F.col(f"{who}_streak")
        flags.append((s >= STRONG_STREAK, F.concat(F.lit(f"{who} buys "), s.cast("string"))))
        flags.append((s <= -STRONG_STREAK, F.concat(F.lit(f"{who} sells "), F.abs(s).cast("string"))))
    return (
        streaks.join(today, "instrument_id", "left").join(volume, "instrument_id", "left").join(balance, "instrument_id", "left")
        .select(
            "instrument_id", "foreign_streak", "trust_streak", "dealer_streak",
            F.when(
                F.col("volume_same") > 0, ratio(f + t + F.col("dealer_net"), F.col("volume_same")) * 100
            ).alias("dominance_pct"),
            "volume_today",
            F.when(F.col("volume_mean") > 0, ratio("volume_today", "volume_mean")).alias("volume_ratio"),
            F.when(F.col("margin_balance") > 0, ratio("short_balance", "margin_balance") * 100).alias("short_margin_pct"),
            share("margin_balance").alias("margin_volume_pct"),
            share("short_balance").alias("short_volume_pct"),
            tag_text(tags(*flags, limit=2)).alias("chip_label"),
        )
    )


def flow_windows(
    inst: DataFrame, margin: DataFrame, dates: int = 10, suffix: str = "", flow_days: Days | None = None, balance_days: Days | None = None
) -> DataFrame:
    """Flow sums and balance changes over the last dates that have values.

    Each measure looks at the last dates on which any instrument has it; ``balance_days``
    are those of both balances, where known.
    """
    flows = on_last_dates(inst, flow_days or Days.of(inst), dates).groupBy("instrument_id").agg(
        *[F.sum(c).alias(f"{c}{suffix}") for c in FLOWS]
    )
    out = flows
    for c in ("margin_balance", "short_balance"):
        have = margin.filter(F.col(c).isNotNull()).select("instrument_id", "date", c)
        change = on_last_dates(have, balance_days or Days.of(have), dates).groupBy("instrument_id").agg(
            (F.max_by(c, "date") - F.min_by(c, "date")).alias(c.replace("balance", "change") + suffix)
        )
        out = out.join(change, "instrument_id", "left")
    return out


def day_flows(
    inst: DataFrame, margin: DataFrame, offset: int = 0, suffix: str = "_today", flow_days: Days | None = None, balance_days: Days | None = None
) -> DataFrame:
    """Flows of one date and balance changes into one, ``offset`` dates before the newest of each table."""
    day = (flow_days or Days.of(inst)).earlier(offset)
    flow = on_last_dates(inst, day, 1).select("instrument_id", *[F.col(c).alias(f"{c}{suffix}") for c in FLOWS])
    pair = last_two(margin, (balance_days or Days.of(margin)).earlier(offset), "margin_balance", "short_balance")
    change = pair.filter(F.col("margin_balance").isNotNull()).select(
        "instrument_id",
        (F.col("margin_balance") - F.col("prev_margin_balance")).alias(f"margin_change{suffix}"),
        (F.col("short_balance") - F.col("prev_short_balance")).alias(f"short_change{suffix}"),
    )
    return flow.join(change, "instrument_id", "outer")


def today_price(price: DataFrame, calendar: DataFrame | Days) -> DataFrame:
    """Newest close and its change on the previous date."""
    pair = last_two(price, Days.of(calendar), "close").filter(F.col("close").isNotNull())
    prev = F.col("prev_close")
    return pair.select(
        "instrument_id", F.col("close").alias("close_today"),
        F.when(prev > 0, ratio(F.col("close") - prev, prev) * 100).alias("change_today_pct"),
    )


def day_trade_ratio(day_trade: DataFrame, price: DataFrame, calendar: DataFrame) -> DataFrame:
    """Day-trade share of volume on the newest date."""
    both = on_last_dates(price, calendar, 1).join(day_trade, ["instrument_id", "date"])
    return both.filter("volume > 0").select(
        "instrument_id", (ratio("dt_vol", "volume") * 100).alias("day_trade_pct")
    )


def day_trade_trend(day_trade: DataFrame, price: DataFrame, n: int = 5) -> DataFrame:
    """Mean share of the last n rows and whether the newest runs hot or cool against the rest."""
    joined = day_trade.join(price.select("instrument_id", "date", "volume"), ["instrument_id", "date"]).filter("volume > 0")
    rows = top_rows(
        joined.select("instrument_id", "date", (ratio("dt_vol", "volume") * 100).alias("share")), newest_first("instrument_id"), n
    )
    stats = rows.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("share").alias("day_trade_mean_pct"),
        F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("today"),
        F.avg(F.when(F.col("rank") > 1, F.col("share"))).alias("base"),
    )
    base = F.col("base")
    heat = (
        F.when((base > 0) & (F.col("today") > base * 1.2), "heating")
        .when((base > 0) & (F.col("today") < base * 0.8), "cooling").otherwise("steady")
    )
    return stats.filter("rows >= 2").select("instrument_id", "day_trade_mean_pct", heat.alias("day_trade_heat"))


def sbl_latest(sbl: DataFrame, calendar: DataFrame, max_stale: int = MAX_STALE_DAYS) -> DataFrame:
    """Newest balance of each instrument, its change, its own date and age in trading dates.

    A balance more than ``max_stale`` trading dates old is dropped, never shown as current.
    """
    two = top_rows(sbl, newest_first("instrument_id"), 2)
    latest = two.groupBy("instrument_id").agg(
        F.max_by("sbl_balance", "date").alias("sbl_balance"),
        F.when(F.count(F.lit(1)) == 2, F.max_by("sbl_balance", "date") - F.min_by("sbl_balance", "date")).alias("sbl_change"),
        F.max("date").alias("date"),
    )
    return (
        latest.join(calendar.select("date", (F.col("age") - 1).alias("stale_dates")), "date")
        .filter(F.col("stale_dates") <= max_stale)
        .select("instrument_id", "sbl_balance", "sbl_change", F.col("date").alias("sbl_date"), "stale_dates")
    )


def holder_trend(holders: DataFrame) -> DataFrame:
    """Every report with the change of the top-tier share on the instrument's previous one."""
    w = Window.partitionBy("instrument_id").orderBy("date")
    return holders.select(
        "instrument_id", "date", "pct_1000", "pct_400",
        F.round(F.col("pct_1000") - F.lag("pct_1000").over(w), 2).alias("pct_1000_change"),
    )


def holder_change(holders: DataFrame) -> DataFrame:
    """(instrument_id, holder_pct, holder_change) between the two newest reports of the whole table."""
    pair = last_two(holders, Days.of(holders), "pct_1000").filter(F.col("pct_1000").isNotNull())
    return pair.select(
        "instrument_id", F.round("pct_1000", 2).alias("holder_pct"),
        F.round(F.col("pct_1000") - F.col("prev_pct_1000"), 2).alias("holder_change"),
    )


def holder_change_own(holders: DataFrame) -> DataFrame:
    """Change between each instrument's own two newest reports."""
    two = top_rows(holders, newest_first("instrument_id"), 2)
    return two.groupBy("instrument_id").agg(
        F.max_by("pct_1000", "date").alias("holder_pct"),
        F.when(F.count(F.lit(1)) == 2, F.round(F.max_by("pct_1000", "date") - F.min_by("pct_1000", "date"), 2)).alias("holder_change"),
    )


def share_stats(shareholding: DataFrame, price: DataFrame, calendar: DataFrame | Days, tries: int = 3) -> DataFrame:
    """Foreign share, market value and turnover of shares outstanding at the newest date.

    The report date falls back up to ``tries`` - 1 days when nothing is out yet.
    """
    days = Days.of(calendar)
    last = days.newest()
    recent = shareholding.filter((F.col("date") <= last) & (F.col("date") > F.date_sub(last, tries)))
    report = recent.agg(F.max("date").alias("d")).select("d").scalar()
    shares = F.col("shares_issued")
    return (
        shareholding.filter(F.col("date") == report).select("instrument_id", "foreign_pct", "shares_issued")
        .join(on_last_dates(price, days, 1).select("instrument_id", "close", "volume"), "instrument_id")
        .select(
            "instrument_id", "foreign_pct",
            F.when(shares > 0, F.col("close") * shares / 1e8).alias("market_value"),
            F.when(shares > 0, ratio("volume", shares / LOT_SHARES) * 100).alias("turnover_pct"),
        )
    )
