"""Composite tables: verdicts, attribution, the lock screen, follow-up and the daily report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LOT_SHARES, Broker, LockScreen
from ..functions.columns import detail_map, pct_simple, ratio, vote
from ..functions.windows import newest_first, ordered, top_rows
from ..session import cut_lineage
from ..sources.calendar import on_last_dates
from . import brokers
from .joins import enrich
from .screens import limit_up_candidates

# Separators and class words of the stored list texts.
LIST_SEP = "、"


def verdict_vote(df: DataFrame) -> DataFrame:
    """Adds verdict_votes and verdict from the signal columns present; a missing one is neutral."""

    def have(c: str, expr) -> Column:
        return expr(F.col(c)) if c in df.columns else F.lit(0)

    votes = (
        have("dominance_pct", lambda c: vote(F.bround(c, 1), 3, -3))
        + have("margin_volume_pct", lambda c: -vote(F.bround(c, 1), 5, -2))
        + have("ma_align", lambda c: F.when(c == "bull", 1).when(c == "bear", -1).otherwise(0))
        + have("long_term", lambda c: F.when(c == "above both", 1).when(c == "below both", -1).otherwise(0))
        + have("bias20_pct", lambda c: vote(F.bround(c, 1), 0, 0))
        + have("year_position_pct", lambda c: vote(F.bround(c, 0), 70, 30))
        + have("short_margin_pct", lambda c: F.when(F.bround(c, 1) > 20, 1).otherwise(0))
    )
    return df.withColumn("verdict_votes", votes).withColumn("verdict", verdict_label("verdict_votes"))


def verdict_label(c: str) -> Column:
    return F.when(F.col(c) >= 3, "bull").when(F.col(c) <= -3, "bear").otherwise("watch")


def tech_snapshot(tech: DataFrame, chip: DataFrame, fund: DataFrame | None = None) -> DataFrame:
    """Technical and flow row of every instrument with the combined vote and label."""
    out = verdict_vote(enrich(tech, chip))
    if fund is None:
        return out
    out = enrich(out, fund.select("instrument_id", "fund_votes"))
    total = F.col("verdict_votes") + F.coalesce("fund_votes", F.lit(0))
    return out.withColumn("total_votes", total).withColumn("verdict", verdict_label("total_votes"))


def move_attribution(price: DataFrame, inst: DataFrame, margin: DataFrame, rows: int = 5) -> DataFrame:
    """Why each instrument moved: its newest row against the one before, as rule texts."""
    key = ["instrument_id", "date"]
    w = ordered("instrument_id")
    recent = top_rows(price.select(*key, "close", "volume"), newest_first("instrument_id"), rows + 1)
    m = recent.join(inst.select(*key, "foreign_net", "trust_net", "dealer_net"), key, "left").join(
        margin.select(*key, "margin_balance", "short_balance"), key, "left"
    )
    for c in ("foreign_net", "trust_net", "dealer_net"):
        m = m.withColumn(c, F.coalesce(c, F.lit(0.0)))
    prev = F.lag("close").over(w)
    m = m.withColumns({
        "change_pct": F.when(prev > 0, ratio(F.col("close") - prev, prev) * 100),
        "margin_change": F.col("margin_balance") - F.lag("margin_balance").over(w),
        "short_change": F.col("short_balance") - F.lag("short_balance").over(w),
    })
    t = m.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") > 1, F.col("volume"))).alias("usual"),
        F.max_by(F.struct("date", "volume", "foreign_net", "trust_net", "dealer_net", "change_pct", "margin_change", "short_change"), "date").alias("t"),
    ).filter("n >= 2").select("instrument_id", "usual", "t.*")
    net = F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net")
    up = F.round("change_pct", 2) > 0
    mc, sc = F.coalesce("margin_change", F.lit(0.0)), F.coalesce("short_change", F.lit(0.0))
    flows = F.array(*[
        F.struct(F.col(f"{who}_net").alias("v"), F.lit(-i).alias("o"), F.lit(who).alias("who")) for i, who in enumerate(("foreign", "trust", "dealer"))
    ])
    buyer = F.array_max(flows)
    seller = F.array_min(F.transform(flows, lambda x: F.struct(x.v.alias("v"), (-x.o).alias("o"), x.who.alias("who"))))
    biggest = F.array_max(F.transform(flows, lambda x: F.struct(F.abs(x.v).alias("v"), x.o.alias("o"), x.who.alias("who"))))
    against = (buyer.v > 0) & (seller.v < 0) & (F.least(buyer.v, -seller.v) > F.greatest(F.abs(net), F.lit(1.0)) * 1.5)
    lead = F.when(against, F.concat(buyer.who, F.lit(" buys against "), seller.who)).otherwise(F.concat(F.lit("led by "), biggest.who))
    tone = (
        F.when((net > 0) & up, "buyers push the price").when(net > 0, "buyers absorb the dip")
        .when((net < 0) & up, "rises against sellers").when(net < 0, "sellers lead the fall").otherwise("neutral")
    )
    margin_text = (
        F.when((mc > 0) & up, "retail chases").when(mc > 0, "retail catches the knife")
        .when((mc < 0) & up, "retail leaves, cleaner rise").when(mc < 0, "retail is stopped out")
    )
    short_text = F.when(sc > 0, "shorts enter").when((sc < 0) & up, "shorts squeezed").when(sc < 0, "shorts take profit")
    vr = F.when(F.col("usual") > 0, ratio("volume", "usual")).otherwise(0.0)
    volume_text = F.when(vr >= 1.5, "surge").when((vr < 0.7) & (vr > 0), "thin").when(vr > 0, "normal")
    one_line = (
        F.when(up & (net > 0) & (mc <= 0), "institutions buy, retail stays out: clean rise")
        .when(up & (net > 0), "institutions and retail buy: crowded rise")
        .when(up & (mc > 0), "retail alone chases: doubtful rise")
        .when(up, "no institutional buying: theme or day trade")
        .when((net < 0) & (mc > 0), "institutions sell, retail catches: most dangerous")
        .when(net < 0, "institutions lead the fall")
        .when(mc < 0, "retail is stopped out")
        .otherwise("pullback without institutional selling")
    )
    return t.select(
        "instrument_id", "date", "change_pct", net.alias("inst_net"), "margin_change", "short_change", vr.alias("volume_ratio"),
        tone.alias("flow_tone"), lead.alias("flow_lead"), margin_text.alias("margin_note"), short_text.alias("short_note"),
        volume_text.alias("volume_note"), one_line.alias("one_line"),
    )


def holdings_attribution(holdings: DataFrame, attribution: DataFrame) -> DataFrame:
    return attribution.join(holdings.select("instrument_id"), "instrument_id", "left_semi").select("instrument_id", "one_line")


def holding_status(holdings: DataFrame, price: DataFrame, info: DataFrame, calendar: DataFrame) -> DataFrame:
    """Value, profit and alert of every holding at the newest close; the stop is checked first."""
    latest = on_last_dates(price, calendar, 1).select("instrument_id", F.col("close").alias("price"))
    h = holdings.join(latest, "instrument_id", "left").join(info.select("instrument_id", "instrument_name"), "instrument_id", "left")
    p, cost = F.col("price"), F.col("cost")
    alert = (
        F.when(p <= F.col("stop"), "stop hit").when(p >= F.col("target"), "target hit")
        .when(p.isNotNull() & F.col("stop").isNotNull(), "above stop").otherwise("")
    )
    return h.select(
        "instrument_id", "instrument_name", "lots", "cost", "price", pct_simple(p, cost).alias("profit_pct"),
        ((p - cost) * F.col("lots") * LOT_SHARES).alias("profit"),
        (cost * F.col("lots") * LOT_SHARES).alias("cost_value"),
        F.when(alert == "above stop", ratio(p - F.col("stop"), p) * 100).alias("to_stop_pct"), alert.alias("alert"),
    )


def holding_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("n_holdings"), F.sum("cost_value").alias("total_cost"), F.sum("profit").alias("total_profit"),
        (ratio(F.sum("profit"), F.sum("cost_value")) * 100).alias("total_return_pct"),
    )


def _listing(entries: Column, show: int) -> Column:
    """First entries joined, and how many more there are."""
    more = F.when(F.size(entries) > show, F.concat(F.lit(" +"), (F.size(entries) - show).cast("string"))).otherwise("")
    return F.when(F.size(entries) > 0, F.concat(F.array_join(F.slice(entries, 1, show), LIST_SEP), more))


def lock_screen(
    price: DataFrame, info: DataFrame, day_trade: DataFrame, nets: DataFrame, calendar: DataFrame,
    p: LockScreen = LockScreen(), b: Broker = Broker(), profile: DataFrame | None = None,
) -> DataFrame:
    """Limit-up candidates of the newest date with who locked them and who may sell tomorrow.

    ``profile`` is the broker profile where it is stored already.

    The blacklists name frequent flippers across the market and on the instrument
    itself among today's top buyers, and only where the main brokers are net buyers.
    """
    # a handful of candidates and their brokers of one window: stored, every list below reads them once more, not the facts
    cands = cut_lineage(limit_up_candidates(price, calendar, p), "lock-candidates")
    own_history = cut_lineage(on_last_dates(nets, calendar, p.lookback + 1).join(cands.select("instrument_id"), "instrument_id", "left_semi"), "lock-nets")
    today, prev = cands.select("instrument_id", "date"), cands.select("instrument_id", F.col("prev_date").alias("date"))
    of_today = own_history.join(today, ["instrument_id", "date"], "left_semi")
    of_prev = own_history.join(prev, ["instrument_id", "date"], "left_semi")
    main_today = brokers.broker_main_net(of_today, b.top).select("instrument_id", F.col("main_net").alias("main_net_today"))
    main_prev = brokers.broker_main_net(of_prev, b.top).select("instrument_id", F.col("main_net").alias("main_net_prev"))
    pressure = brokers.flip_pressure(of_prev.unionByName(of_today), price, calendar, b.top).select("instrument_id", "flip_pressure_pct")
    # a stored table of one row per broker: its real size decides whether joins broadcast it
    profile = cut_lineage(brokers.broker_profile(nets, calendar, b), "profile") if profile is None else profile
    expected = brokers.expected_pressure(of_today, profile, price, b).select("instrument_id", "expected_lots", "expected_pct")
    regulars = brokers.flip_regulars(own_history, calendar, p.lookback, b.top, p.min_hits).select("instrument_id", "broker", "hits")

    buyers = (
        brokers.top_buyers(of_today, b.top)
        .join(profile.select("broker", "flip_rate"), "broker", "left").join(regulars, ["instrument_id", "broker"], "left")
        .withColumn("lots", F.bround("net").cast("long"))
        .withColumn("market", F.coalesce(F.col("flip_rate") >= b.mid, F.lit(False))).withColumn("own", F.col("hits").isNotNull())
    )
    name = F.concat("broker", F.lit("+"), F.col("lots").cast("string"))
    # at most ``top`` buyers per instrument
    entry = F.struct(
        "rank", "net", "lots", "market", "own", name.alias("plain"),
        F.concat(name, F.lit(" "), F.floor("flip_rate").cast("string"), F.lit("%")).alias("rated"),
    )
    lists = buyers.groupBy("instrument_id").agg(F.sort_array(F.collect_list(entry)).alias("buys"))

    def pick(cond, field: str) -> Column:
        return F.transform(F.filter("buys", cond), lambda x: x[field])

    named = F.slice(F.filter("buys", lambda x: x.market | x.own), 1, p.detail_top)
    lists = lists.select(
        "instrument_id",
        _listing(pick(lambda x: x.market, "rated"), 2).alias("market_blacklist"),
        _listing(pick(lambda x: x.own, "plain"), 2).alias("own_blacklist"),
        F.when(F.size(named) > 0, F.aggregate(named, F.lit(0).cast("long"), lambda acc, x: acc + x.lots)).alias("blacklist_lots"),
        F.when(F.size(named) > 0, F.array_join(F.transform(named, lambda x: x.plain), LIST_SEP)).alias("blacklist_detail"),
    )
    locked = F.col("main_net_today") > 0
    out = (
        cands.join(info, "instrument_id", "left").join(day_trade, ["instrument_id", "date"], "left")
        .join(main_prev, "instrument_id", "left").join(main_today, "instrument_id", "left").join(pressure, "instrument_id", "left")
        .join(expected, "instrument_id", "left").join(lists, "instrument_id", "left")
    )
    only_locked = [
        F.when(locked, F.col(c)).alias(c)
        for c in ("expected_lots", "expected_pct", "market_blacklist", "own_blacklist", "blacklist_lots", "blacklist_detail")
    ]
    return out.select(
        "date", "instrument_id", "rank", "instrument_name", F.col("type").alias("market"), "industry", "close", "change_pct", "turnover",
        (ratio("dt_vol", "volume") * 100).alias("day_trade_pct"), "main_net_prev", "main_net_today", "flip_pressure_pct", *only_locked,
    )


def save_picks(tracks: DataFrame, n: int = 15) -> DataFrame:
    """The first n rows of each track and date with their rank; ``tracks`` has track, date, instrument_id, score."""
    w = Window.partitionBy("track", "date").orderBy(F.col("score").desc(), "instrument_id")
    return top_rows(tracks, w, n).select("date", "track", "rank", "instrument_id")


def prior_picks(picks: DataFrame, today: str | Column) -> DataFrame:
    """Rows of the newest recorded date before ``today``."""
    limit = F.lit(today).cast("date") if isinstance(today, str) else today
    past = picks.filter(F.col("date") < limit)
    newest = past.agg(F.max("date").alias("d")).select("d").scalar()
    return past.filter(F.col("date") == newest)


def follow_through(picks: DataFrame, attribution: DataFrame, today: str | Column) -> DataFrame:
    """How the last recorded picks moved, and why."""
    moves = attribution.select("instrument_id", "change_pct", "one_line")
    return prior_picks(picks, today).join(moves, "instrument_id").select("date", "track", "rank", "instrument_id", "change_pct", "one_line")


def follow_stats(moves: DataFrame) -> DataFrame:
    return moves.filter("change_pct is not null").groupBy("track").agg(
        F.avg("change_pct").alias("avg_change_pct"), F.count_if(F.col("change_pct") > 0).alias("up"), F.count(F.lit(1)).alias("n")
    )


def lock_follow_up(
    picks: DataFrame, price: DataFrame, day_trade: DataFrame, nets: DataFrame, calendar: DataFrame, top: int = 15
) -> DataFrame:
    """Open-to-close course of earlier lock picks on the newest date, against what was planned.

    ``picks`` is one recorded day: date, rank, instrument_id, main_net, expected_pct, detail.
    Its label may fall on a closed day; the last trading date at or before it counts.  Picks of
    the newest date itself have no course yet and give no rows.
    """
    # stored: they are made once, and their number decides how they meet the tables
    picks = cut_lineage(picks, "picks")
    label = picks.agg(F.max("date").alias("d")).select("d").scalar()
    newest = calendar.agg(F.max("date").alias("d")).select("d").scalar()
    ref = calendar.filter(F.col("date") <= label).agg(F.max("date").alias("d")).select("d").scalar()
    picked = price.join(picks.select("instrument_id"), "instrument_id", "left_semi")
    cur = picked.filter((F.col("date") == newest) & (newest > ref))
    before = picked.filter(F.col("date") == ref).select("instrument_id", F.col("close").alias("prev_close"))
    usual = top_rows(picked.filter(F.col("date") < newest).select("instrument_id", "date", "volume"), newest_first("instrument_id"), 20)
    usual = usual.groupBy("instrument_id").agg(F.avg("volume").alias("usual"), F.count(F.lit(1)).alias("n_usual"))
    mine = nets.join(picks.select("instrument_id"), "instrument_id", "left_semi")
    steps = mine.filter(F.col("date") == ref).select("instrument_id", "date").distinct().withColumn("next_date", newest)
    realised = brokers.follow_up(mine, steps, top).groupBy("instrument_id").agg(F.sum("dumped").alias("overlap"))
    today_nets = mine.filter(F.col("date") == newest)
    main = brokers.broker_main_net(today_nets, top).select("instrument_id", "main_net")
    names = picks.select("instrument_id", F.explode(detail_map("detail")).alias("broker", "bought"))
    sold = names.join(today_nets.select("instrument_id", "broker", "net"), ["instrument_id", "broker"], "left").groupBy("instrument_id").agg(
        F.sum("bought").alias("blacklist_bought"),
        F.sum(F.when(F.bround("net") < 0, -F.bround("net")).otherwise(0.0)).cast("long").alias("blacklist_sold"),
    )
    o, h, low, c, pc = (F.col(x) for x in ("open", "high", "low", "close", "prev_close"))
    return (
        picks.drop("date").withColumnRenamed("main_net", "locked_net").join(cur, "instrument_id").join(before, "instrument_id").filter((pc > 0) & (o > 0))
        .join(usual, "instrument_id", "left").join(realised, "instrument_id", "left").join(main, "instrument_id", "left").join(sold, "instrument_id", "left")
        .join(day_trade, ["instrument_id", "date"], "left")
        .select(
            "rank", "instrument_id", ref.alias("ref_date"), F.col("date").alias("trade_date"), "locked_net", "expected_pct",
            F.when(F.col("volume") > 0, ratio("overlap", "volume") * 100).alias("realised_pct"), F.col("main_net").alias("main_net_today"),
            "blacklist_bought", "blacklist_sold", (ratio("blacklist_sold", "blacklist_bought") * 100).alias("sold_pct"),
            pct_simple(c, pc).alias("change_pct"), pct_simple(o, pc).alias("gap_pct"), pct_simple(c, o).alias("intraday_pct"),
            pct_simple(c, h).alias("fade_pct"), (ratio(h - low, pc) * 100).alias("amplitude_pct"),
            F.when(F.col("n_usual") >= 5, ratio("volume", "usual")).alias("volume_ratio"),
            (ratio("dt_vol", "volume") * 100).alias("day_trade_pct"),
        )
    )


def lock_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.avg("gap_pct").alias("gap_pct"), F.avg("intraday_pct").alias("intraday_pct"),
        F.count_if(F.col("intraday_pct") < 0).alias("faded"), F.count(F.lit(1)).alias("n"),
    )


def main_force_branches(ranked: DataFrame, nets: DataFrame, calendar: DataFrame, n: int = 10, top: int = 15) -> DataFrame:
    """Adds the newest date's top-broker totals to the n best rows; the others stay null."""
    best = ranked.orderBy(F.col("score").desc(), "instrument_id").limit(n).select("instrument_id")
    today = on_last_dates(nets, calendar, 1).join(F.broadcast(best), "instrument_id", "left_semi")
    totals = brokers.broker_main_net(today, top).select("instrument_id", "main_buy", "main_sell", "main_net")
    return enrich(ranked, totals)


def data_health(price: DataFrame, floor: float = 0.7) -> DataFrame:
    """Dates whose row count fell below the given share of the date before."""
    w = Window.orderBy("date")  # one row per date
    counts = price.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prev_n", F.lag("n").over(w)).select("date", "n", "prev_n", (F.col("n") < F.col("prev_n") * floor).alias("incomplete"))


def daily_report(candidates: DataFrame, signals: Sequence[DataFrame]) -> DataFrame:
    """Candidates of all tracks with every signal table, joined once for all tracks.

    Every signal table has one row per instrument.  They are stacked, each in a column of
    its own, and brought together by one aggregation, whatever their number; the candidates
    then meet them in a single join.  Columns already present win, and the verdict comes
    after the signals it votes on.
    """
    key, taken, stacked, shown = "instrument_id", set(candidates.columns), [], []
    for i, s in enumerate(signals):
        own = [c for c in s.columns if c not in taken]
        if own:
            taken |= set(own)
            stacked.append(s.select(key, F.struct(*own).alias(f"s{i}")))
            shown += [F.col(f"s{i}")[c].alias(c) for c in own]
    if not stacked:
        return verdict_vote(candidates)
    rows = stacked[0]
    for s in stacked[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    # a candidate's parts only; there are few candidates, and their number decides how they are joined
    wanted = cut_lineage(candidates, "candidates")
    rows = rows.join(wanted.select(key).distinct(), key, "left_semi")
    merged = rows.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c != key])
    return verdict_vote(wanted.join(merged, key, "left").select(*candidates.columns, *shown))


def pack_windows(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Several windows of one measure in one text cell, missing ones as a dash."""
    cells = [F.coalesce(F.format_number(c, 0), F.lit("-")) for c in columns]
    return df.withColumn(out, F.concat_ws(" / ", *cells))
