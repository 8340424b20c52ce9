"""Trades and equity curves for whole grids of configurations in one job.

A configuration is a row, not a loop: grids explode into the data as literals, and
every step is keyed by ``curve_id`` so that all configurations, folds and strategies
share the same shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COSTS, PERIODS_PER_YEAR, Costs
from ..functions.columns import ratio, round_trip_return
from ..functions.quantiles import with_scalar
from ..functions.windows import cumulative_growth, drawdown, normalised, ordered, running, top_rows, trailing, true_range
from ..session import cut_lineage

NO_STOP = {"stop_kind": "none", "stop_param": 0.0}


BAR = ("idx", "date", "open", "low", "close")


def entry_paths(bars: DataFrame, entries: DataFrame, calendar: DataFrame, holds: Sequence[int], atr_rows: int = 14) -> DataFrame:
    """Every wanted entry bar with what happens next.

    ``entries``: instrument_id, date and ``cfgs``.  ``path``: the instrument's bars from the
    entry to the longest hold, by calendar index.  ``exit_<hold>``: its first bar at or
    after ``hold`` dates.  A bar without a positive close is a missing quote and is
    skipped.  Only wanted entries are laid out by date, and they meet the bars by equal
    index; every other bar stays one row.  A bar knows the one after it, so an exit that
    falls on a missing quote is found from the last bar before it, however far away.
    """
    w = ordered("instrument_id", by="idx")
    bar = F.struct(*BAR)
    atr = F.when(F.count(F.lit(1)).over(trailing(w, atr_rows)) == atr_rows, F.avg("tr").over(trailing(w, atr_rows)))
    base = bars.filter("close > 0").join(calendar.select("date", "idx"), "date").withColumn("tr", true_range(w))
    base = base.select("instrument_id", "idx", bar.alias("bar"), F.lead(bar).over(w).alias("next"), atr.alias("atr"))
    # stored: its size decides how it meets the bars, and signals are computed once
    wanted = cut_lineage(entries.join(calendar.select("date", F.col("idx").alias("at")), "date"), "entries")
    days = wanted.select("instrument_id", "at", F.explode(F.sequence("at", F.col("at") + max(holds))).alias("idx"))
    met = days.join(base, ["instrument_id", "idx"]).groupBy("instrument_id", "at").agg(F.sort_array(F.collect_list(F.struct("idx", "bar", "next", "atr"))).alias("met"))
    entry = F.get("met", F.lit(0))
    out = wanted.join(met, ["instrument_id", "at"]).filter((entry.idx == F.col("at")) & (entry.bar.open > 0))

    def timed(hold: int) -> Column:
        last = F.element_at(F.filter("met", lambda x: x.idx <= F.col("at") + hold), -1)
        return F.when(last.idx == F.col("at") + hold, last.bar).otherwise(last.next)

    return out.select(
        "instrument_id", "date", F.col("at").alias("idx"), entry.bar.open.alias("open"), entry.bar.close.alias("close"), "cfgs", entry.atr.alias("atr"),
        F.transform("met", lambda x: x.bar).alias("path"), *[timed(hold).alias(f"exit_{hold}") for hold in holds],
    )


def stop_price(entry: Column, atr: Column, kind: Column, param: Column) -> Column:
    """Percent or true-range stop; null when there is none."""
    return (
        F.when(kind == "pct", entry * (F.lit(1.0) - param))
        .when((kind == "atr") & (atr > 0), entry - param * atr)
    )


def signal_trades(
    signals: DataFrame, bars: DataFrame, calendar: DataFrame, holds: Sequence[int] = (20,), costs: Costs = COSTS
) -> DataFrame:
    """One trade per signal: in at the next date's open, out at the stop or after the hold.

    ``signals`` carries curve_id, date, instrument_id, hold, stop_kind and stop_param; holds
    must be listed in ``holds``.  The stop is checked before the time exit, from the
    entry bar on; a bar that opens below it fills at the open.  Trades still open at
    the end of the panel have no exit.  ``path`` lists the held bars.
    """
    cfg = F.struct("curve_id", "hold", "stop_kind", "stop_param", F.col("date").alias("signal_date"), F.col("idx").alias("signal_idx"))
    # at most one entry per configuration and bar
    entries = (
        signals.join(calendar.select("date", "next_date", "idx"), "date").filter("next_date is not null")
        .groupBy("instrument_id", F.col("next_date").alias("date")).agg(F.collect_list(cfg).alias("cfgs"))
    )
    entered = entry_paths(bars, entries, calendar, holds).withColumn("cfg", F.explode("cfgs"))
    entered = entered.select("*", "cfg.*").drop("cfg", "cfgs")
    timed = F.lit(None).cast(entered.schema[f"exit_{holds[0]}"].dataType)
    for hold in holds:
        timed = F.when(F.col("hold") == hold, F.col(f"exit_{hold}")).otherwise(timed)
    entered = entered.withColumn("timed", timed).withColumn(
        "stop", stop_price(F.col("open"), F.col("atr"), F.col("stop_kind"), F.col("stop_param"))
    )
    # held bars: up to the hold, plus the later bar that the time exit had to wait for
    late = F.when(F.col("timed.idx") > F.col("idx") + F.col("hold"), F.array("timed"))
    held = F.filter("path", lambda b: b.idx <= F.col("idx") + F.col("hold"))
    entered = entered.withColumn("held", F.when(late.isNotNull(), F.concat(held, late)).otherwise(held))
    hit = F.get(F.filter("held", lambda b: b.low <= F.col("stop")), F.lit(0))
    entered = entered.withColumn("hit", hit)
    stopped = F.col("hit").isNotNull()
    exit_idx = F.when(stopped, F.col("hit.idx")).otherwise(F.col("timed.idx"))
    exit_price = F.when(stopped, F.least(F.col("hit.open"), F.col("stop"))).otherwise(F.col("timed.close"))
    out = entered.withColumn("exit_idx", exit_idx).withColumn("exit_price", exit_price)
    return out.select(
        "curve_id", "instrument_id", "signal_date", "signal_idx", F.col("date").alias("entry_date"), F.col("open").alias("entry_price"),
        F.when(stopped, F.col("hit.date")).otherwise(F.col("timed.date")).alias("exit_date"),
        "exit_price",
        F.when(F.col("exit_price").isNotNull(), round_trip_return("open", "exit_price", costs)).alias("ret"),
        F.when(stopped, "stop").when(F.col("timed").isNotNull(), "time").alias("exit_reason"),
        F.filter("held", lambda b: F.col("exit_idx").isNull() | (b.idx <= F.col("exit_idx"))).alias("path"),
        "exit_idx",
    )


def trade_days(trades: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """Daily return of every open trade; costs fall on the first and the last day.

    Returns are formed inside the path array, so the exploded rows stay narrow.
    """

    def day(bar: Column, k: Column) -> Column:
        before = F.when(k == 0, F.col("entry_price") * (1 + costs.buy)).otherwise(F.get(F.col("path"), k - 1).close)
        value = F.when(bar.idx == F.col("exit_idx"), F.col("exit_price") * (1 - costs.sell)).otherwise(bar.close)
        return F.struct(k.alias("k"), bar.date.alias("date"), bar.idx.alias("idx"), (ratio(value, before) - 1).alias("day_ret"))

    return trades.select("curve_id", "signal_idx", "ret", F.inline(F.transform("path", day)))


def cohort_sums(days: DataFrame, *keys: str | Column) -> DataFrame:
    """Additive parts of the cohort statistics per date.

    Closed trades are counted on their first day, so trade statistics need no second
    pass over the trades.
    """
    closed = (F.col("k") == 0) & F.col("ret").isNotNull()
    return days.groupBy(*keys, "idx").agg(
        F.sum("day_ret").alias("sum_day"), F.count(F.lit(1)).alias("n_open"), F.count_if(closed).alias("n_closed"),
        F.count_if(closed & (F.col("ret") > 0)).alias("n_won"), F.sum(F.when(closed, F.col("ret")).otherwise(0.0)).alias("sum_ret"),
    )


def cohort_returns(days: DataFrame) -> DataFrame:
    """Equal weight over the trades open on each date."""
    return cohort_sums(days, "curve_id").withColumn("day_ret", ratio("sum_day", "n_open")).drop("sum_day")


def equity_curve(returns: DataFrame, calendar: DataFrame, curves: DataFrame, keys: Sequence[str] = ("curve_id",)) -> DataFrame:
    """Compounded equity on every calendar date of each curve; idle dates earn nothing.

    ``curves`` lists the curves with lo_idx and hi_idx, a handful of rows per
    configuration, exploded into their dates.
    """
    dates = curves.withColumn("idx", F.explode(F.sequence("lo_idx", "hi_idx"))).drop("lo_idx", "hi_idx")
    filled = dates.join(calendar.select("idx", "date"), "idx").join(
        returns, [*keys, "idx"], "left"
    ).fillna({c: 0 for c in ("day_ret", "n_open", "n_closed", "n_won", "sum_ret")})
    w = Window.partitionBy(*keys).orderBy("idx")
    return filled.withColumn("equity", cumulative_growth("day_ret", w))


def curve_metrics(curve: DataFrame, keys: Sequence[str] = ("curve_id",), periods: int = PERIODS_PER_YEAR, by: str = "date") -> DataFrame:
    """Growth, drawdown, Sharpe and volatility of each equity curve.

    A curve that carries cohort counts also gets its trade statistics and exposure.
    """
    w = Window.partitionBy(*keys).orderBy(by)
    prev = F.lag("equity").over(w)
    cohort = [c for c in ("n_open", "n_closed", "n_won", "sum_ret") if c in curve.columns]
    step = curve.select(
        *keys, by, "equity", *cohort, F.when(prev > 0, ratio("equity", prev) - 1).alias("r"), drawdown("equity", w).alias("dd")
    )
    extra, stats = [], []
    if len(cohort) == 4:
        extra = [F.avg((F.col("n_open") > 0).cast("double")).alias("open"), *[F.sum(c).alias(c) for c in cohort[1:]]]
        stats = [
            F.col("n_closed").alias("n_trades"), (ratio("n_won", "n_closed") * 100).alias("win_rate_pct"),
            ratio("sum_ret", "n_closed").alias("mean_ret"), (F.col("open") * 100).alias("exposure_pct"),
        ]
    s = step.groupBy(*keys).agg(
        *extra,
        F.count(F.lit(1)).alias("n"), F.min_by("equity", by).alias("first"), F.max_by("equity", by).alias("last"),
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("dd").alias("dd"),
    )
    # deviations this small are rounding noise of a flat curve
    moves = F.col("sd") > 1e-12
    years = F.col("n") / float(periods)
    return s.select(
        *keys, "n",
        (F.when(F.col("n") > 1, F.pow(F.col("last") / F.col("first"), F.lit(1.0) / years) - 1).otherwise(0.0) * 100).alias("cagr_pct"),
        (F.coalesce("dd", F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        F.when(moves, F.col("mean") / F.col("sd") * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe"),
        F.when(moves, F.col("sd") * F.sqrt(F.lit(float(periods))) * 100).otherwise(0.0).alias("volatility_pct"),
        *stats,
    )


def trade_stats(trades: DataFrame, keys: Sequence[str] = ("curve_id",)) -> DataFrame:
    """Closed trades, share of winners and mean return."""
    closed = trades.filter("ret is not null")
    return closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("win_rate_pct"),
        F.avg("ret").alias("mean_ret"),
    )


def buy_hold_curve(bars: DataFrame) -> DataFrame:
    """Mean over instruments of closes normalised to each one's first close."""
    w = ordered("instrument_id")
    first = F.first("close").over(running(w))
    norm = bars.withColumn("first", first).filter("first > 0").withColumn("norm", normalised("close", w))
    return norm.groupBy("date").agg(F.avg("norm").alias("equity"))


def timed_curve(index: DataFrame, gate: DataFrame) -> DataFrame:
    """The index return only on dates whose previous gate was open; cash otherwise."""
    w = Window.orderBy("date")  # one row per date: bounded by the calendar
    open_before = F.coalesce(F.lag("regime_ok").over(w), F.lit(True))
    prev = F.lag("equity").over(w)
    r = F.when(prev.isNotNull() & open_before, ratio("equity", prev) - 1).otherwise(0.0)
    step = index.join(gate.select("date", "regime_ok"), "date", "left")
    return step.select("date", r.alias("day_ret"), (prev.isNotNull() & open_before).alias("invested")).select(
        "date", "invested", cumulative_growth("day_ret", w).alias("equity")
    )


def fold_bounds(n: Column, i: Column, k: int) -> dict[str, Column]:
    """Index bounds of fold i of k over n dates: training from the start, test after it."""
    lo = F.floor(n * (i + 1) / (k + 1))
    hi = F.floor(n * (i + 2) / (k + 1))
    return {"train_hi": lo, "test_lo": lo + 1, "test_hi": F.least(hi, n - 1)}


def make_folds(calendar: DataFrame, k: int = 3) -> DataFrame:
    """Expanding training windows with adjacent test windows."""
    n = calendar.agg(F.count(F.lit(1)).alias("n"))
    i = F.col("i")
    b = fold_bounds(F.col("n"), i, k)
    folds = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        F.concat(F.lit("F"), (i + 1).cast("string")).alias("fold"), F.lit(0).cast("long").alias("train_lo_idx"),
        b["train_hi"].alias("train_hi_idx"), b["test_lo"].alias("test_lo_idx"), b["test_hi"].alias("test_hi_idx"),
        F.floor(F.col("n") * (i + 2) / (k + 1)).alias("cut"),
    ).filter("test_lo_idx < cut")
    for c in ("train_lo", "train_hi", "test_lo", "test_hi"):
        folds = folds.join(calendar.select(F.col("idx").alias(f"{c}_idx"), F.col("date").alias(c)), f"{c}_idx")
    return folds.select("fold", *[x for c in ("train_lo", "train_hi", "test_lo", "test_hi") for x in (c, f"{c}_idx")])


def expand_grid(signals: DataFrame, grid: Sequence[dict], gate: DataFrame | None = None) -> DataFrame:
    """Signals once per configuration, best ``max_positions`` of each date, gated if asked.

    A configuration has curve_id, max_positions, hold, stop_kind, stop_param, regime (0 or
    1) and optionally signal, the name of the signal set it trades.
    """
    names = list(grid[0])
    cfg = F.array(*[F.struct(*[F.lit(g[n]).alias(n) for n in names]) for g in grid])
    w = Window.partitionBy(*(["signal"] if "signal" in names else []), "date").orderBy(F.col("score").desc(), "instrument_id")
    ranked = top_rows(signals, w, max(g["max_positions"] for g in grid))
    if gate is not None:
        ranked = ranked.join(F.broadcast(gate.select("date", "regime_ok")), "date", "left")  # one row per date
        ok = (F.col("cfg.regime") == 0) | F.coalesce("regime_ok", F.lit(True))
    else:
        ok = F.lit(True)
    match = F.col("cfg.signal") == F.col("signal") if "signal" in names else F.lit(True)
    exploded = ranked.withColumn("cfg", F.explode(cfg)).filter(match & (F.col("rank") <= F.col("cfg.max_positions")) & ok)
    return exploded.select("date", "instrument_id", "score", *[F.col(f"cfg.{n}").alias(n) for n in names if n != "signal"])


def grid_curves(
    signals: DataFrame, grid: Sequence[dict], bars: DataFrame, calendar: DataFrame, gate: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(trades, equity curves) of every configuration over the whole calendar."""
    holds = sorted({g["hold"] for g in grid})
    trades = signal_trades(expand_grid(signals, grid, gate), bars, calendar, holds)
    span = calendar.agg(F.min("idx").alias("lo_idx"), F.max("idx").alias("hi_idx"))
    curves = span.withColumn("curve_id", F.explode(F.array(*[F.lit(g["curve_id"]) for g in grid])))
    return trades, equity_curve(cohort_returns(trade_days(trades)), calendar, curves)


def compare(
    signals: DataFrame, grid: Sequence[dict], bars: DataFrame, calendar: DataFrame, gate: DataFrame | None = None,
    periods: int = PERIODS_PER_YEAR,
) -> DataFrame:
    """One row of metrics per configuration, from one pass over the trades."""
    _, curves = grid_curves(signals, grid, bars, calendar, gate)
    return curve_metrics(curves, periods=periods)


def fold_curves(trades: DataFrame, calendar: DataFrame, grid: Sequence[dict], k: int = 3) -> DataFrame:
    """Equity of every (configuration, fold, role): only signals and days inside its window.

    Trades are summed per configuration, date and segment of their signal date between
    the cuts.  Folds then add up segments, so no trade is copied per fold: training is
    every segment below its cut, a test is the one segment behind it.
    """
    size = calendar.agg(F.count(F.lit(1)).alias("n_dates"))
    bounds = [fold_bounds(F.col("n_dates"), F.lit(i), k) for i in range(k)]
    cuts = [b["train_hi"] for b in bounds]
    signal = F.col("signal_idx")
    segment = sum(((signal >= c).cast("int") + (signal > c).cast("int") for c in cuts), F.lit(0))
    roles = []
    for i, b in enumerate(bounds):
        name = F.lit(f"F{i + 1}").alias("fold")
        roles.append(F.struct(
            name, F.lit("train").alias("role"), F.lit(0).cast("long").alias("lo_idx"), b["train_hi"].alias("hi_idx"),
            F.lit(0).alias("seg_lo"), F.lit(2 * i).alias("seg_hi"),
        ))
        roles.append(F.struct(
            name, F.lit("test").alias("role"), b["test_lo"].alias("lo_idx"), b["test_hi"].alias("hi_idx"),
            F.lit(2 * i + 2).alias("seg_lo"), F.lit(2 * i + 2).alias("seg_hi"),
        ))
    windows = size.select(F.inline(F.array(*roles))).filter("hi_idx > lo_idx")
    curves = windows.drop("seg_lo", "seg_hi").withColumn("curve_id", F.explode(F.array(*[F.lit(g["curve_id"]) for g in grid])))
    parts = cohort_sums(with_scalar(trade_days(trades), size, "n_dates"), "curve_id", "n_dates", segment.alias("segment"))
    keys = ("curve_id", "fold", "role")
    returns = (
        parts.select("*", F.inline(F.array(*roles)))
        .filter(F.col("segment").between(F.col("seg_lo"), F.col("seg_hi")) & (F.col("idx") <= F.col("hi_idx")))
        .groupBy(*keys, "idx").agg(*[F.sum(c).alias(c) for c in ("sum_day", "n_open", "n_closed", "n_won", "sum_ret")])
        .withColumn("day_ret", ratio("sum_day", "n_open")).drop("sum_day")
    )
    return equity_curve(returns, calendar, curves, keys)


def best_by(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configuration with the highest (Sharpe, growth) per key; ties go to the smaller id.

    Growth compares as a logarithm, so equal curves tie at any size.
    """
    growth = F.round(F.log1p(F.col("cagr_pct") / 100), 6)
    w = Window.partitionBy(*keys).orderBy(F.round("sharpe", 6).desc(), growth.desc(), "curve_id")
    return top_rows(metrics, w, 1).drop("rank")


def grid_walk_forward(
    signals: DataFrame, grid: Sequence[dict], bars: DataFrame, calendar: DataFrame, gate: DataFrame | None = None,
    k: int = 3, periods: int = PERIODS_PER_YEAR,
) -> tuple[DataFrame, DataFrame]:
    """(choice per fold, stitched out-of-sample curve) of a whole grid in one job.

    Each fold's configuration is the best of its training window; the test returns of
    the chosen ones follow each other on one curve.
    """
    holds = sorted({g["hold"] for g in grid})
    trades = signal_trades(expand_grid(signals, grid, gate), bars, calendar, holds)
    curves = fold_curves(trades, calendar, grid, k)
    metrics = curve_metrics(curves, ("curve_id", "fold", "role"), periods)
    # both roles side by side: the choice and its test come from the same rows
    sides = metrics.groupBy("fold", "curve_id").agg(*[
        F.max(F.when(F.col("role") == role, F.col(c))).alias(out)
        for role, c, out in (
            ("train", "sharpe", "sharpe"), ("train", "cagr_pct", "cagr_pct"),
            ("test", "sharpe", "test_sharpe"), ("test", "cagr_pct", "test_cagr_pct"), ("test", "max_drawdown_pct", "test_drawdown_pct"),
        )
    ])
    chosen = best_by(sides, ["fold"]).withColumnsRenamed({"sharpe": "train_sharpe", "cagr_pct": "train_cagr_pct"})
    # one row per fold
    picked = curves.filter("role = 'test'").join(F.broadcast(chosen.select("fold", "curve_id")), ["fold", "curve_id"])
    w = Window.orderBy("idx")  # test windows do not overlap: one row per date
    stitched = picked.select(
        F.lit("oos").alias("curve_id"), "fold", F.col("curve_id").alias("config"), "idx", "date", "day_ret",
        cumulative_growth("day_ret", w).alias("equity"),
    )
    return chosen, stitched
