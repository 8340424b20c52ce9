"""Batch normalisation of landed raw files (numbers, ids, dates, units)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    COMMON_SHARE,
    local_date,
    local_period,
    number,
    shares_to_lots,
    shares_to_lots_rounded,
)


def common_instruments(df: DataFrame, code: str = "instrument_id") -> DataFrame:
    """Only four-digit common share ids."""
    return df.filter(F.trim(F.col(code)).rlike(COMMON_SHARE))


def normalize_quotes(raw: DataFrame) -> DataFrame:
    """Text quotes (local date, thousands separators, shares) to typed bars in lots.

    A missing quote becomes 0, which the screens guard against.
    """
    return raw.select(
        F.trim("code").alias("instrument_id"),
        local_date("day").alias("date"),
        *[number(c).alias(c) for c in ("open", "high", "low", "close")],
        shares_to_lots(number("shares")).alias("volume"),
    ).filter(F.col("date").isNotNull())


def normalize_flows(raw: DataFrame) -> DataFrame:
    """Investor flows in shares to lots.

    The total is converted on its own, so it may differ from the sum of its parts.
    """
    lots = {c: shares_to_lots(number(c)) for c in ("foreign_net", "trust_net", "dealer_net", "total_net")}
    return raw.select(
        F.trim("code").alias("instrument_id"), local_date("day").alias("date"),
        *[v.alias(k) for k, v in lots.items()],
    ).filter(F.col("date").isNotNull())


def normalize_balances(raw: DataFrame) -> DataFrame:
    """Borrowing balances in shares to lots (rounded); rows without a balance are rejected."""
    shares = F.regexp_replace(F.trim("shares"), ",", "").try_cast("double")
    return raw.select(
        F.trim("code").alias("instrument_id"), local_date("day").alias("date"),
        shares_to_lots_rounded(shares).alias("sbl_balance"),
    ).dropna(subset=["date", "sbl_balance"])


def normalize_revenue(raw: DataFrame) -> DataFrame:
    """Monthly revenue with its publication date: as stated, else the 10th of the next month."""
    stated = F.substring(F.trim("created"), 1, 10).try_cast("date")
    fallback = F.date_add(F.add_months(F.make_date("year", "month", F.lit(1)), 1), 9)
    return raw.select(
        F.trim("code").alias("instrument_id"), "year", "month",
        number("revenue").alias("revenue"), F.coalesce(stated, fallback).alias("pub_date"),
    ).dropna(subset=["year", "month", "revenue"])


def normalize_notices(raw: DataFrame) -> DataFrame:
    """Restriction notices: numeric codes only, period text to two dates."""
    start, end = local_period("period")
    return raw.filter(F.col("code").rlike(r"^\d+$")).select(
        F.col("code").cast("long").alias("instrument_id"),
        start.alias("start_date"), end.alias("end_date"), "kind",
    )


def normalize_dividend_notices(raw: DataFrame) -> DataFrame:
    """Ex-dividend notices; amounts that are not positive become null."""

    def positive(c: str):
        v = number(c)
        return F.when(v > 0, v).alias(c)

    return (
        raw.filter(F.col("code").rlike(r"^\d+$"))
        .select(F.col("code").cast("long").alias("instrument_id"), local_date("day").alias("date"), positive("cash"), positive("share_dividend"))
        .filter(F.col("date").isNotNull())
    )


def concentration_from_tiers(tiers: DataFrame) -> DataFrame:
    """Holder tiers to the shares of the top tier (15) and of tiers 12 to 15."""

    def share(cond):
        return F.round(F.sum(F.when(cond, F.col("percent")).otherwise(0.0)), 2)

    return tiers.groupBy("date", "instrument_id").agg(
        share(F.col("level") == 15).alias("pct_1000"),
        share(F.col("level").between(12, 15)).alias("pct_400"),
    )


def broker_net_from_trades(trades: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Net lots per (instrument, date, broker); a broker without a name goes by its id.

    ``deal`` says how rows are dealt out before they are summed: one name and one number each.
    """
    rows = trades.select("instrument_id", "date", F.coalesce("broker_name", "broker_id").alias("broker"), (F.col("buy") - F.col("sell")).alias("net"))
    return deal(rows).groupBy("instrument_id", "date", "broker").agg((F.sum("net") / 1000).alias("net"))


def broker_maps(nets: DataFrame) -> DataFrame:
    """Long nets to one JSON map per (instrument, date), the stored form."""
    return nets.groupBy("instrument_id", "date").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("broker", "net"))))).alias("nets")
    )


def broker_rows(maps: DataFrame) -> DataFrame:
    """JSON maps back to long rows."""
    parsed = F.from_json("nets", "map<string,double>")
    return maps.select("instrument_id", "date", F.explode(parsed).alias("broker", "net"))
