"""Broker behaviour: who buys today and sells tomorrow, per instrument and across all.

Input is the long form (instrument_id, date, broker, net).  The rows of one (instrument_id,
date) are its brokers, a bounded set; everything across instruments is aggregated
per broker with partial sums first, so a broker that trades everything is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Broker
from ..functions.columns import ratio
from ..functions.windows import ordered, top_rows
from ..session import shuffle_parts
from .joins import next_date_pairs


def _by_bar(*order) -> Window:
    return Window.partitionBy("instrument_id", "date").orderBy(*order)


def top_buyers(nets: DataFrame, top: int) -> DataFrame:
    """The largest positive nets of each (instrument, date); ties go by broker name."""
    return top_rows(nets.filter("net > 0"), _by_bar(F.col("net").desc(), "broker"), top)


def leading_nets(nets: DataFrame, top: int) -> DataFrame:
    """The largest nets of each (instrument, date): all its top buyers, or sellers alone where nobody buys."""
    return top_rows(nets, _by_bar(F.col("net").desc(), "broker"), top)


def top_sellers(nets: DataFrame, top: int) -> DataFrame:
    return top_rows(nets.filter("net < 0"), _by_bar("net", "broker"), top)


def broker_main_net(nets: DataFrame, top: int = 15) -> DataFrame:
    """Net of the largest buyers and sellers per (instrument, date), with counts and totals.

    Ranks among buyers and among sellers come from one sort of the group.
    """
    buy_rank = F.row_number().over(_by_bar(F.col("net").desc(), "broker"))
    sell_rank = F.row_number().over(_by_bar("net", F.col("broker").desc()))
    ranked = nets.withColumn("b", buy_rank).withColumn("s", sell_rank)
    buy = (F.col("b") <= top) & (F.col("net") > 0)
    sell = (F.col("s") <= top) & (F.col("net") < 0)
    zero = F.lit(0.0)
    return ranked.groupBy("instrument_id", "date").agg(
        F.sum(F.when(buy | sell, F.col("net")).otherwise(zero)).alias("main_net"),
        F.sum(F.when(buy, F.col("net")).otherwise(zero)).alias("main_buy"),
        F.sum(F.when(sell, F.col("net")).otherwise(zero)).alias("main_sell"),
        F.count_if(buy).alias("n_buyers"), F.count_if(sell).alias("n_sellers"),
    )


def adjacent_steps(nets: DataFrame, calendar: DataFrame) -> DataFrame:
    """(instrument_id, date, next_date) where both adjacent calendar dates have broker rows."""
    present = nets.select("instrument_id", "date").distinct()
    return next_date_pairs(present, present, calendar, ["instrument_id"], "inner")


def available_steps(nets: DataFrame) -> DataFrame:
    """(instrument_id, date, next_date) between an instrument's own dates, over calendar gaps."""
    w = Window.partitionBy("instrument_id").orderBy("date")
    days = nets.select("instrument_id", "date").distinct()
    return days.withColumn("next_date", F.lead("date").over(w)).filter("next_date is not null")


def follow_up(nets: DataFrame, steps: DataFrame, top: int) -> DataFrame:
    """Every top buy with the same broker's net on the step's next date; absent counts as 0."""
    buys = top_buyers(nets, top).select("instrument_id", "date", "broker", F.col("net").alias("bought"))
    after = nets.select("instrument_id", F.col("date").alias("next_date"), "broker", F.col("net").alias("after"))
    joined = buys.join(steps, ["instrument_id", "date"]).join(after, ["instrument_id", "next_date", "broker"], "left")
    sold = F.coalesce("after", F.lit(0.0)) < 0
    return joined.select(
        "instrument_id", "broker", F.col("date").alias("buy_date"), F.col("next_date").alias("sell_date"), "bought",
        sold.cast("long").alias("flip"),
        F.when(sold, F.least("bought", -F.col("after"))).otherwise(0.0).alias("dumped"),
    )


def by_bar(rows: DataFrame, *aggs: Column) -> DataFrame:
    """One row for each (instrument, date): ``entries``, its broker rows by net, largest first and missing ones last, then by broker, and ``aggs``.

    ``rows`` has ``entry``, a struct of broker and net or null.  It crosses one exchange, by
    instrument, in as many parts as shuffles start with: windows over dates need no other.
    """
    known = rows.filter("instrument_id is not null").repartition(shuffle_parts(rows.sparkSession), "instrument_id")
    placed = F.transform(F.collect_list("entry"), lambda x: F.struct(x.net.isNull().alias("none"), (-x.net).alias("order"), x.broker.alias("broker"), x.net.alias("net")))
    return known.groupBy("instrument_id", "date").agg(F.sort_array(placed).alias("entries"), *aggs)


def bar_main_net(entries: Column, top: int) -> Column:
    """Net of a bar's largest buyers and sellers, as ``broker_main_net`` has it."""
    buy = F.filter(F.slice(entries, 1, top), lambda x: x.net > 0)
    sell = F.filter(F.slice(F.reverse(entries), 1, top), lambda x: x.net < 0)
    return F.aggregate(F.concat(buy, sell), F.lit(0.0), lambda total, x: total + x.net)


def bar_sales(entries: Column, after: Column, top: int) -> Column:
    """A bar's top buys as (broker, bought, after), with the same broker's net in a later bar or null."""

    def met(buy: Column) -> Column:
        own = F.filter(after, lambda x: x.broker == buy.broker)
        nets = F.when(F.size(own) > 0, F.transform(own, lambda x: x.net)).otherwise(F.array(F.lit(None)))
        return F.transform(nets, lambda net: F.struct(buy.broker.alias("broker"), buy.net.alias("bought"), net.alias("after")))

    return F.flatten(F.transform(F.slice(F.filter(entries, lambda x: x.net > 0), 1, top), met))


def dumped(bought: Column, after: Column) -> Column:
    """What of a buy was sold, at most all of it."""
    return F.when(after < 0, F.least(bought, -after)).otherwise(0.0)


def buyer_follow_up(nets: DataFrame, calendar: DataFrame, top: int) -> DataFrame:
    """Top buys and what followed on the next calendar date, where the instrument has broker rows on it; see ``follow_up``."""
    bars = by_bar(nets.select("instrument_id", "date", F.struct("broker", "net").alias("entry")))
    bars = bars.withColumn("next", F.lead(F.struct("date", "entries")).over(ordered("instrument_id")))
    stepped = bars.join(calendar.select("date", "next_date"), "date").filter(F.col("next.date") == F.col("next_date"))
    sales = stepped.select("instrument_id", F.col("date").alias("buy_date"), F.col("next_date").alias("sell_date"), F.inline(bar_sales(F.col("entries"), F.col("next.entries"), top)))
    return sales.select(
        "instrument_id", "broker", "buy_date", "sell_date", "bought",
        (F.coalesce("after", F.lit(0.0)) < 0).cast("long").alias("flip"), dumped(F.col("bought"), F.col("after")).alias("dumped"),
    )


def flip_pressure(nets: DataFrame, price: DataFrame, calendar: DataFrame, top: int = 15) -> DataFrame:
    """Yesterday's top buyers' sales today, capped at what they bought, over today's volume.

    A bar whose previous date had broker rows but no buyer has no pressure, not a missing one.
    """
    steps = adjacent_steps(nets, calendar)
    sold = follow_up(nets, steps, top).groupBy("instrument_id", F.col("sell_date").alias("date")).agg(F.sum("dumped").alias("overlap"))
    bar = ["instrument_id", "date"]
    stepped = steps.select("instrument_id", F.col("next_date").alias("date")).join(price.select(*bar, "volume"), bar).filter("volume > 0")
    overlap = F.coalesce("overlap", F.lit(0.0))
    return stepped.join(sold, bar, "left").select(*bar, overlap.alias("overlap"), (ratio(overlap, "volume") * 100).alias("flip_pressure_pct"))


def _class(rate: str, p: Broker):
    c = F.col(rate)
    return (
        F.when(c >= p.hot, "hot").when(c >= p.mid, "mid").when(c < p.long, "long").otherwise("neutral")
    )


def profile_rates(counters: DataFrame, p: Broker = Broker()) -> DataFrame:
    """Rates and class of (broker, ops, flips, bought, dumped, n_instruments) counters."""
    return (
        counters.filter(F.col("ops") >= p.min_ops)
        .withColumn("flip_rate", F.round(ratio("flips", "ops") * 100, 1))
        .withColumn("dump_ratio", F.when(F.col("bought") > 0, F.round(ratio("dumped", "bought") * 100, 1)).otherwise(0.0))
        .select("broker", "ops", "flips", "flip_rate", "dump_ratio", "n_instruments", _class("flip_rate", p).alias("broker_class"))
    )


def broker_profile(nets: DataFrame, calendar: DataFrame, p: Broker = Broker(), before: str | Column | None = None) -> DataFrame:
    """Behaviour of every broker across all instruments and dates.

    ``before`` uses only pairs that were complete before that date.
    """
    pairs = buyer_follow_up(nets, calendar, p.top)
    if before is not None:
        pairs = pairs.filter(F.col("sell_date") < F.lit(before).cast("date"))
    per_instrument = pairs.groupBy("broker", "instrument_id").agg(
        F.count(F.lit(1)).alias("ops"), F.sum("flip").alias("flips"),
        F.sum("bought").alias("bought"), F.sum("dumped").alias("dumped"),
    )
    counters = per_instrument.groupBy("broker").agg(
        F.sum("ops").alias("ops"), F.sum("flips").alias("flips"), F.sum("bought").alias("bought"),
        F.sum("dumped").alias("dumped"), F.count(F.lit(1)).alias("n_instruments"),
    )
    return profile_rates(counters, p)


def expected_pressure(
    nets: DataFrame, profile: DataFrame, price: DataFrame, p: Broker = Broker()
) -> DataFrame:
    """Tomorrow's likely selling: each frequent flipper's buy times its usual dump ratio.

    A bar without such buyers, or without any buyer, gets 0, not null; without any profile
    there are no rows.  ``profile`` is best a stored table: the planner then knows that it is
    small and no broker becomes a hot join key.
    """
    rates = profile.select("broker", "flip_rate", "dump_ratio")
    known = rates.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() > 0
    return _pressure(leading_nets(nets, p.top).filter(known).join(rates, "broker", "left"), price, p)


def _pressure(leading: DataFrame, price: DataFrame, p: Broker) -> DataFrame:
    hot = (F.col("net") > 0) & (F.col("flip_rate") >= p.mid)
    est = leading.groupBy("instrument_id", "date").agg(
        F.sum(F.when(hot, F.col("net") * F.col("dump_ratio") / 100).otherwise(0.0)).alias("expected_lots"),
        F.count_if(hot).alias("n_flippers"),
    )
    volume = price.select("instrument_id", "date", "volume")
    share = F.when(F.col("n_flippers") == 0, 0.0).when(F.col("volume") > 0, ratio("expected_lots", "volume") * 100)
    return est.join(volume, ["instrument_id", "date"], "left").select(
        "instrument_id", "date", "expected_lots", "n_flippers", share.alias("expected_pct")
    )


def flip_regulars(nets: DataFrame, calendar: DataFrame, lookback: int = 8, top: int = 15, min_hits: int = 2) -> DataFrame:
    """Brokers that repeatedly buy and sell the next day within the newest dates, per instrument.

    Steps go from one available date to the next, unlike those of the profile.
    """
    window = nets.join(
        F.broadcast(calendar.filter(F.col("age") <= lookback + 1).select("date")), "date", "left_semi"
    )
    flips = follow_up(window, available_steps(window), top).filter("flip = 1")
    return flips.groupBy("instrument_id", "broker").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("dumped").alias("dumped")
    ).filter(F.col("hits") >= min_hits)


def top_branches(nets: DataFrame, profile: DataFrame, n: int = 10) -> DataFrame:
    """The n largest buyers and sellers of each (instrument, date) with their class."""
    buy = top_buyers(nets, n).withColumn("side", F.lit("buy"))
    sell = top_sellers(nets, n).withColumn("side", F.lit("sell"))
    info = profile.select("broker", "flip_rate", "ops", "broker_class")
    return buy.unionByName(sell).join(info, "broker", "left").select(
        "instrument_id", "date", "side", "rank", "broker", "net", "flip_rate", "ops", "broker_class"
    )


def profile_listing(profile: DataFrame, n: int = 10) -> DataFrame:
    """Top brokers of each class: highest flip rate first, lowest first for the long class."""
    sign = F.when(F.col("broker_class") == "long", F.col("flip_rate")).otherwise(-F.col("flip_rate"))
    w = Window.partitionBy("broker_class").orderBy(sign, F.col("ops").desc(), "broker")
    return top_rows(profile, w, n)


def broker_timeline(nets: DataFrame, price: DataFrame, calendar: DataFrame, top: int = 15) -> DataFrame:
    """Main net and flip pressure per (instrument, date)."""
    pressure = flip_pressure(nets, price, calendar, top).select("instrument_id", "date", "flip_pressure_pct")
    return broker_main_net(nets, top).select("instrument_id", "date", "main_net").join(pressure, ["instrument_id", "date"], "left")


def profile_history(nets: DataFrame, calendar: DataFrame, p: Broker = Broker()) -> DataFrame:
    """Running counters of each broker after every date on which a pair completed.

    Contributions carry the sell date.  They are summed per broker and date before the
    running sum, so a broker's partition holds at most one row per trading date.
    """
    pairs = buyer_follow_up(nets, calendar, p.top)
    per_instrument = pairs.groupBy("broker", "instrument_id", "sell_date").agg(
        F.count(F.lit(1)).alias("ops"), F.sum("flip").alias("flips"),
        F.sum("bought").alias("bought"), F.sum("dumped").alias("dumped"),
    )
    first = Window.partitionBy("broker", "instrument_id").orderBy("sell_date")
    daily = (
        per_instrument.withColumn("new_instrument", (F.row_number().over(first) == 1).cast("long"))
        .groupBy("broker", F.col("sell_date").alias("date"))
        .agg(*[F.sum(c).alias(c) for c in ("ops", "flips", "bought", "dumped")], F.sum("new_instrument").alias("n_instruments"))
    )
    run = Window.partitionBy("broker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("broker", "date", *[F.sum(c).over(run).alias(c) for c in ("ops", "flips", "bought", "dumped", "n_instruments")])


def history_as_of(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Profile counters valid for the wanted (broker, date) pairs: those of the broker's last earlier date.

    One sweep per broker over its own dates, at most twice the calendar.
    """
    counters = [c for c in history.columns if c not in ("broker", "date")]
    rows = history.select("broker", "date", F.lit(1).alias("kind"), F.struct(*counters).alias("known"))
    asked = wanted.select("broker", "date").distinct().select("broker", "date", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["known"].dataType).alias("known"))
    before = Window.partitionBy("broker").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, -1)
    swept = rows.unionByName(asked).withColumn("last", F.last("known", ignorenulls=True).over(before))
    return swept.filter((F.col("kind") == 0) & F.col("last").isNotNull()).select("broker", "date", "last.*")


def pit_expected_pressure(
    nets: DataFrame, price: DataFrame, calendar: DataFrame, p: Broker = Broker(), history: DataFrame | None = None
) -> DataFrame:
    """Expected pressure of every bar from a profile of strictly earlier dates; none before the first profile.

    ``history`` is the broker history where it is stored already.
    """
    history = profile_history(nets, calendar, p) if history is None else history
    first = history.filter(F.col("ops") >= p.min_ops).agg(F.min("date").alias("d")).select("d").scalar()
    leading = leading_nets(nets.filter(F.col("date") > first), p.top)
    rates = profile_rates_by_date(history_as_of(history, leading.filter("net > 0")), p)
    return _pressure(leading.join(rates, ["broker", "date"], "left"), price, p)


def profile_rates_by_date(counters: DataFrame, p: Broker) -> DataFrame:
    return counters.filter(F.col("ops") >= p.min_ops).select(
        "broker", "date",
        F.round(ratio("flips", "ops") * 100, 1).alias("flip_rate"),
        F.when(F.col("bought") > 0, F.round(ratio("dumped", "bought") * 100, 1)).otherwise(0.0).alias("dump_ratio"),
    )


def regular_hits(nets: DataFrame, calendar: DataFrame, lookback: int = 8, top: int = 15) -> DataFrame:
    """(instrument_id, broker, date, hits): flips inside the window of ``lookback`` dates up to each date.

    A flip counts for every date from its sale until its purchase leaves the window, so
    it is laid out at most ``lookback`` times and counted by key.
    """
    idx = calendar.select("date", "idx")
    flips = (
        follow_up(nets, available_steps(nets), top).filter("flip = 1")
        .join(idx.select(F.col("date").alias("buy_date"), F.col("idx").alias("b")), "buy_date")
        .join(idx.select(F.col("date").alias("sell_date"), F.col("idx").alias("s")), "sell_date")
        .filter(F.col("s") <= F.col("b") + lookback)
    )
    seen = flips.select("instrument_id", "broker", F.explode(F.sequence("s", F.col("b") + lookback)).alias("idx"))
    return seen.groupBy("instrument_id", "broker", "idx").agg(F.count(F.lit(1)).alias("hits")).join(idx, "idx").drop("idx")
