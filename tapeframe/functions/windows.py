"""Window column builders over a (key, date) panel.

A panel row is unique per (key, date), so one key's window partition never holds
more rows than the trading calendar has days, however skewed the raw facts are.
All builders take the same ordered window, so Spark sorts each partition once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import cut_lineage
from .columns import col, ratio


def ordered(*keys: str, by: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def newest_first(*keys: str, by: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(by).desc())


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full_frame(c: Column, w: WindowSpec, n: int) -> Column:
    """c where the trailing frame holds n rows, else null."""
    return F.when(F.count(F.lit(1)).over(trailing(w, n)) == n, c)


def sma(c: str | Column, w: WindowSpec, n: int) -> Column:
    return full_frame(F.avg(col(c)).over(trailing(w, n)), w, n)


def rows_back(c: str | Column, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(col(c), n).over(w)


def diff(c: str | Column, w: WindowSpec) -> Column:
    return col(c) - rows_back(c, w)


def return_n(c: str | Column, w: WindowSpec, n: int = 1) -> Column:
    """c against its value n rows back, null unless that value is positive."""
    base = rows_back(c, w, n)
    return F.when(base > 0, ratio(c, base) - 1)


def row_index(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def volatility(c: str | Column, w: WindowSpec, n: int) -> Column:
    """Population deviation of the last n values of c."""
    return F.stddev_pop(col(c)).over(trailing(w, n))


def true_range(w: WindowSpec, high="high", low="low", close="close") -> Column:
    """The first row has no previous close and uses high - low only."""
    prev = rows_back(close, w)
    return F.greatest(
        col(high) - col(low), F.abs(col(high) - prev), F.abs(col(low) - prev)
    )


def running_max(c: str | Column, w: WindowSpec) -> Column:
    return F.max(col(c)).over(running(w))


def drawdown(c: str | Column, w: WindowSpec) -> Column:
    return ratio(c, running_max(c, w)) - 1


def cumulative_growth(r: str | Column, w: WindowSpec) -> Column:
    return F.exp(F.sum(F.log1p(col(r))).over(running(w)))


def with_sliding_range(df: DataFrame, c: str, n: int, hi: str, lo: str, key: str = "instrument_id", by: str = "date") -> DataFrame:
    """Adds the highest and lowest of the last n rows at constant work per row.

    Rows fall into blocks of n.  A trailing frame is the tail of one block and the head
    of the next, so running extremes from both ends of the blocks cover it; a plain
    frame would look at n rows again for every row.
    """
    w = ordered(key, by=by)
    block = Window.partitionBy(key, "__block")
    head, tail = running(block.orderBy(by)), running(block.orderBy(F.col(by).desc()))
    out = df.withColumn("__block", F.floor(row_index(w) / n)).withColumns({
        "__head_hi": F.max(c).over(head), "__head_lo": F.min(c).over(head),
        "__tail_hi": F.max(c).over(tail), "__tail_lo": F.min(c).over(tail),
    })
    return out.withColumns({
        hi: F.greatest("__head_hi", F.lag("__tail_hi", n - 1).over(w)), lo: F.least("__head_lo", F.lag("__tail_lo", n - 1).over(w)),
    }).drop("__block", "__head_hi", "__head_lo", "__tail_hi", "__tail_lo")


def with_range_position(df: DataFrame, c: str, n: int, min_rows: int, out: str, key: str = "instrument_id", by: str = "date") -> DataFrame:
    """Adds the place of c in the range of its last n rows, 0 to 100."""
    hi, lo = F.col("__hi"), F.col("__lo")
    ranged = with_sliding_range(df, c, n, "__hi", "__lo", key, by)
    enough = F.row_number().over(ordered(key, by=by)) >= min_rows
    return ranged.withColumn(out, F.when(enough & (hi > lo), ratio(col(c) - lo, hi - lo) * 100)).drop("__hi", "__lo")


def normalised(c: str | Column, w: WindowSpec) -> Column:
    return ratio(c, F.first(col(c)).over(running(w)))


def buy_streak(c: str | Column, w: WindowSpec) -> Column:
    """Rows since the last value that is not positive (null breaks)."""
    value, rn = col(c), F.row_number().over(w)
    broken = F.when(F.coalesce(value <= 0, F.lit(True)), rn)
    return rn - F.coalesce(F.max(broken).over(running(w)), F.lit(0))


def with_row_numbers(df: DataFrame, w: WindowSpec, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(w))


def top_rows(df: DataFrame, w: WindowSpec, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each partition.

    The filter on row_number lets Spark keep n rows per key before the shuffle.
    """
    return with_row_numbers(df, w, name).filter(F.col(name) <= n)


def streak_runs(df: DataFrame, key: str, columns: dict[str, str], by: str = "date") -> DataFrame:
    """The newest same-sign run of each column, one row per key: its signed length, and whether a row that ends it was seen.

    A run of no sign has length 0 and is ended.
    """
    w = newest_first(key, by=by)
    step = with_row_numbers(df, w)
    for c in columns:
        sign = F.coalesce(F.signum(F.col(c)), F.lit(0.0))
        step = step.withColumn(f"__sign_{c}", sign)
    for c in columns:
        latest = F.first(F.col(f"__sign_{c}")).over(running(w))
        step = step.withColumn(f"__latest_{c}", latest)
    aggs = []
    for c, out in columns.items():
        sign, latest = F.col(f"__sign_{c}"), F.col(f"__latest_{c}")
        stop = F.min(F.when((sign == 0) | (sign != latest), F.col("rn")))
        length = F.coalesce(stop, F.max("rn") + 1) - 1
        aggs += [(F.max(latest).cast("long") * length).cast("long").alias(out), stop.isNotNull().alias(f"{out}_ended")]
    return step.groupBy(key).agg(*aggs)


def latest_streaks(
    df: DataFrame, key: str, columns: dict[str, str], by: str = "date"
) -> DataFrame:
    """Signed length of the newest same-sign run of each column, one row per key.

    ``columns`` maps a value column to its output name.
    """
    return streak_runs(df, key, columns, by).select(key, *columns.values())


def deepening_streaks(
    df: DataFrame, calendar: DataFrame, keys: DataFrame, columns: dict[str, str], key: str = "instrument_id", start: int = 4, enough: int | None = None
) -> DataFrame:
    """``latest_streaks`` of the given keys, from the newest dates backwards.

    The newest ``start`` dates are read first, then four times as many, and so on; only keys
    with a run that has not ended go on, or those without a row yet.  Bounds are literal
    dates, so files and row groups before them stay closed.  With ``enough``, a run of that
    length counts as ended: its length may be more.  Each step stores a row for each key
    that is left; their number reaches the driver.
    """
    # one value a date
    dates = sorted((r.date for r in calendar.select("date").collect()), reverse=True)
    left, done, n = keys.select(key).distinct(), None, start
    ended = F.lit(True)
    for out in columns.values():
        long_enough = (F.abs(F.col(out)) >= enough) if enough else F.lit(False)
        ended = ended & F.coalesce(F.col(f"{out}_ended") | long_enough, F.lit(False))
    while True:
        whole = n >= len(dates)
        block = df if whole else df.filter(F.col("date") >= F.lit(dates[n - 1]))
        if done is not None:
            block = block.join(left, key, "left_semi")
        runs = cut_lineage(left.join(streak_runs(block, key, columns), key, "left").withColumn("__ended", ended), "streaks")
        seen = runs.filter(F.col(f"{next(iter(columns.values()))}_ended").isNotNull())
        settled = (seen if whole else seen.filter("__ended")).select(key, *columns.values())
        done = settled if done is None else done.unionByName(settled)
        left = runs.filter("NOT __ended").select(key)
        if whole or left.isEmpty():
            return done
        n *= 4
