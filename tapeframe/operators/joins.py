"""Join shapes of the panel: enrich, as-of, adjacent dates, same period last year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(df: DataFrame, signals: DataFrame, on: str | Sequence[str] = "instrument_id") -> DataFrame:
    """Left join that keeps the left side's columns where names clash."""
    keys = [on] if isinstance(on, str) else list(on)
    clash = [c for c in signals.columns if c in df.columns and c not in keys]
    return df.join(signals.drop(*clash), keys, "left")


def panel_from_flows(
    price: DataFrame, institutional: DataFrame | None, margin: DataFrame | None, info: DataFrame
) -> DataFrame:
    """Bars with the chosen investor class (foreign for tpex, trust otherwise) and margin.

    A missing flow is 0; a missing margin balance stays null.  None stands for columns that
    ``price`` has itself, one row for each key: they are read where they are, without a join.
    """
    bar = ["instrument_id", "date"]
    joined = price
    for table, carried in ((institutional, ("foreign_net", "trust_net")), (margin, ("margin_balance",))):
        if table is None:
            # a row without a key meets nothing
            joined = joined.withColumns({c: F.when(F.col("instrument_id").isNotNull() & F.col("date").isNotNull(), F.col(c)) for c in carried})
            price = price.drop(*carried)
        else:
            joined = joined.join(table.select(*bar, *carried), bar, "left")
    joined = joined.join(info.select("instrument_id", "type"), "instrument_id", "left")
    net = F.when(F.col("type") == "tpex", F.col("foreign_net")).otherwise(F.col("trust_net"))
    return joined.select(*price.columns, F.coalesce(net, F.lit(0.0)).alias("inst_net"), "margin_balance")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    key: str = "instrument_id",
    tie_break: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    Both sides are stacked and swept in time order per key and year; the last right row of
    the years before comes from a sum of one row per key and year.  No range comparisons,
    and a key that holds a large share of the rows is as many groups as it has years.
    ``strict`` looks only at earlier times.  Among right rows of one time the last by
    ``tie_break`` wins.
    """
    values = [c for c in right.columns if c != key]
    ties = [f"__b{i}" for i in range(len(tie_break))]
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("s")).schema["s"].dataType)
    packed, whole = F.struct(*values), F.struct(*left.columns)
    probe = left.select(
        F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), whole.alias("__l"), none(right, packed).alias("__r"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(b) for b, c in zip(ties, tie_break)],
    ).withColumn("__year", F.year("__t"))
    build = right.select(
        F.col(key).alias("__k"), F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), none(left, whole).alias("__l"), packed.alias("__r"),
        *[F.col(c).alias(b) for b, c in zip(ties, tie_break)],
    ).withColumn("__year", F.year("__t"))
    w = Window.partitionBy("__k", "__year").orderBy("__t", "__side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    swept = probe.unionByName(build).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter(F.col("__l").isNotNull())
    lasts = build.groupBy("__k", "__year").agg(F.max_by("__r", F.struct("__t", *ties)).alias("__c"))
    years = lasts.unionByName(probe.select("__k", "__year").distinct().withColumn("__c", none(right, packed)))
    years = years.groupBy("__k", "__year").agg(F.max_by("__c", F.col("__c").isNotNull()).alias("__c"))
    before = Window.partitionBy("__k").orderBy("__year").rowsBetween(Window.unboundedPreceding, -1)
    carried = years.select("__k", "__year", F.last("__c", ignorenulls=True).over(before).alias("__c")).filter(F.col("__c").isNotNull())
    out = swept.join(carried, ["__k", "__year"], "left").withColumn("__r", F.coalesce("__r", "__c"))
    keep = [c for c in values if c not in left.columns]
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in keep])


def last_date_on_or_before(labels: DataFrame, calendar: DataFrame, label: str = "label") -> DataFrame:
    """Each label date with the last trading date at or before it (null before the first).

    The calendar's gaps are laid out one row per day, so the lookup is an equi-join;
    labels past the last trading date take that date.
    """
    day = F.explode(F.sequence("date", F.date_sub(F.coalesce("next_date", F.date_add("date", 1)), 1))).alias(label)
    days = calendar.select("date", day)
    newest = calendar.agg(F.max("date").alias("d")).select("d").scalar()
    joined = labels.join(days.withColumnRenamed("date", "ref_date"), label, "left")
    return joined.withColumn("ref_date", F.when(F.col(label) >= newest, newest).otherwise(F.col("ref_date")))


def next_date_pairs(
    today: DataFrame, tomorrow: DataFrame, calendar: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Rows of ``today`` with the row of ``tomorrow`` on the next calendar date, same keys."""
    stepped = today.join(calendar.select("date", "next_date"), "date")
    other = tomorrow.withColumnRenamed("date", "next_date")
    return stepped.join(other, [*keys, "next_date"], how)


def previous_year(df: DataFrame, value: str, out: str, key: str = "instrument_id") -> DataFrame:
    """Adds the value of the same month one year earlier; null when that month is missing.

    Months of one calendar position are ordered by year, so no self-join is needed.
    """
    w = Window.partitionBy(key, "month").orderBy("year")
    same = F.lag("year").over(w) == F.col("year") - 1
    return df.withColumn(out, F.when(same, F.lag(value).over(w)))


def explode_grid(df: DataFrame, grid: Sequence[dict], out: str = "cfg") -> DataFrame:
    """One copy of every row per literal parameter set, as struct column ``out``."""
    names = list(grid[0])
    rows = F.array(*[F.struct(*[F.lit(g[n]).alias(n) for n in names]) for g in grid])
    return df.withColumn(out, F.explode(rows))


def wide(statements: DataFrame, types: Sequence[str]) -> DataFrame:
    """Long (instrument_id, date, type, value) statements to one row per report date.

    Items are picked before the shuffle, so a report's items cross it as one row.  A
    repeated item has its first value, null included.
    """
    value, zero = F.col("value"), F.lit(0).cast(statements.schema["value"].dataType)
    picked = []
    for i, t in enumerate(types):
        own = F.col("type") == t
        picked += [F.first(F.when(own, F.coalesce(value, zero)), True).alias(f"__v{i}"), F.first(F.when(own, value.isNotNull()), True).alias(f"__k{i}")]
    rows = statements.groupBy("instrument_id", "date").agg(*picked)
    return rows.select("instrument_id", "date", *[F.when(F.col(f"__k{i}"), F.col(f"__v{i}")).alias(t) for i, t in enumerate(types)])
