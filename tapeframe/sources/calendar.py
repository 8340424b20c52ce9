"""The trading calendar: one row per date that has a price."""

from __future__ import annotations

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(dates: DataFrame) -> DataFrame:
    """(date, idx, age, prev_date, next_date, n_dates); ``dates`` needs a ``date`` column.

    ``idx`` counts from the oldest date (0), ``age`` from the newest (1).  The window
    has no partition key because its input is one row per date.
    """
    w = Window.orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    idx = F.row_number().over(w).cast("long") - 1
    total = F.count(F.lit(1)).over(whole)
    return (
        dates.select("date").distinct()
        .select(
            "date",
            idx.alias("idx"),
            (total - idx).alias("age"),
            F.lag("date").over(w).alias("prev_date"),
            F.lead("date").over(w).alias("next_date"),
            total.alias("n_dates"),
        )
    )


class Days:
    """The dates of a table as values, newest first: one a date, whatever its rows.

    Filters with them are literals, so they reach the files, and plans need no subquery.
    """

    def __init__(self, dates: Iterable[date]) -> None:
        self.dates = sorted(dates, reverse=True)

    @classmethod
    def of(cls, rows: DataFrame | Days) -> Days:
        """The dates of a calendar or of a table's own rows; one pass over its dates."""
        return rows if isinstance(rows, Days) else cls(r.date for r in rows.select("date").distinct().collect() if r.date is not None)

    def newest(self, back: int = 0) -> Column:
        """The newest date, or the one ``back`` dates before it; null before the first."""
        return F.lit(self.dates[back] if back < len(self.dates) else None).cast("date")

    def earlier(self, n: int) -> Days:
        """Without the ``n`` newest dates."""
        return Days(self.dates[n:])


def last_dates(calendar: DataFrame, n: int) -> DataFrame:
    """The n newest dates."""
    return calendar.filter(F.col("age") <= n).select("date")


def on_last_dates(df: DataFrame, calendar: DataFrame | Days, n: int) -> DataFrame:
    """Rows on the n newest dates.

    Known dates are literals of the scan.  Else the lower bound is a scalar subquery, which
    a file scan applies to row groups, and the semi join with at most n dates makes the
    result exact.
    """
    if isinstance(calendar, Days):
        last = calendar.dates[:n]
        return df.filter((F.col("date") >= last[-1]) & F.col("date").isin(last)) if last else df.limit(0)
    dates = last_dates(calendar, n)
    oldest = dates.agg(F.min("date").alias("d")).select("d").scalar()
    return df.filter(F.col("date") >= oldest).join(F.broadcast(dates), "date", "left_semi")


def on_latest_date(df: DataFrame, newest: date | None = None) -> DataFrame:
    """Rows at the table's own newest date.

    Where the date is known, it reaches the files as a literal; else it is looked up first.
    """
    latest = df.agg(F.max("date").alias("d")).select("d").scalar() if newest is None else F.lit(newest)
    return df.filter(F.col("date") == latest)


def gap_days(calendar: DataFrame, loaded: DataFrame) -> DataFrame:
    """Trading dates that a table has no rows for."""
    return calendar.select("date").join(loaded.select("date").distinct(), "date", "left_anti")


def date_islands(loaded: DataFrame, calendar: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi): runs of adjacent trading dates, by calendar index, that have rows."""
    idx = loaded.select(*keys, "date").distinct().join(calendar.select("date", "idx"), "date")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    return idx.withColumn("run", F.col("idx") - place).groupBy(*keys, "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).drop("run")


def merge_islands(islands: DataFrame, *keys: str) -> DataFrame:
    """Islands of several deliveries as one: those that overlap or touch become one run.

    A key's window holds its islands, never its rows.
    """
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("lo") > F.max("hi").over(before) + 1).cast("int"), F.lit(1))
    runs = islands.withColumn("new", new).withColumn("run", F.sum("new").over(upto))
    return runs.groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def island_gaps(islands: DataFrame, calendar: DataFrame, *keys: str) -> DataFrame:
    """(keys, lo, hi): runs of trading dates without rows, before, between and after merged islands."""
    last = calendar.agg(F.max("idx").alias("n")).select("n").scalar()
    w = Window.partitionBy(*keys).orderBy("lo")
    after = F.struct((F.col("hi") + 1).alias("lo"), (F.coalesce(F.lead("lo").over(w), last + 1) - 1).alias("hi"))
    first = F.struct(F.lit(0).cast("long").alias("lo"), F.when(F.row_number().over(w) == 1, F.col("lo") - 1).otherwise(-1).alias("hi"))
    gaps = islands.withColumn("gaps", F.array(first, after)).select(*keys, F.inline("gaps"))
    return gaps.filter("lo <= hi")


def dates_of_runs(runs: DataFrame, calendar: DataFrame, *keys: str) -> DataFrame:
    """The dates of index runs, one row each."""
    return runs.select(*keys, F.explode(F.sequence("lo", "hi")).alias("idx")).join(calendar.select("idx", "date"), "idx").drop("idx")


def month_starts(calendar: DataFrame) -> DataFrame:
    """First trading date of each month."""
    return calendar.groupBy(F.trunc("date", "MM").alias("month")).agg(F.min("date").alias("date"))
