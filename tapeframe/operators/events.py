"""Event labels: trading restrictions and upcoming ex-dividend dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ordered, top_rows


def _day(today: str | Column) -> Column:
    return F.lit(today).cast("date") if isinstance(today, str) else today


def _md(c: str) -> Column:
    return F.date_format(c, "MM-dd")


def restriction_labels(notices: DataFrame, today: str | Column) -> DataFrame:
    """One label per instrument: restricted now or soon, else under attention.

    Of several restrictions the one that ends last counts; an ended one gives no label,
    and an attention notice then still shows.
    """
    day = _day(today)
    last = (
        notices.filter("kind = 'restricted'").groupBy("instrument_id")
        .agg(F.max(F.struct("end_date", "start_date")).alias("r")).select("instrument_id", "r.*")
        .filter(F.col("end_date").isNull() | (F.col("end_date") >= day))
    )
    till = F.coalesce(F.concat(F.lit(" until "), _md("end_date")), F.lit(""))
    label = F.when(
        F.col("start_date") > day, F.concat(F.lit("restricted from "), _md("start_date"), till)
    ).otherwise(F.concat(F.lit("restricted"), till))
    restricted = last.select("instrument_id", label.alias("restriction"), F.lit(1).alias("precedence"))
    attention = notices.filter("kind = 'attention'").select(
        "instrument_id", F.lit("attention").alias("restriction"), F.lit(2).alias("precedence")
    ).distinct()
    return top_rows(restricted.unionByName(attention), ordered("instrument_id", by="precedence"), 1).select("instrument_id", "restriction")


def dividend_labels(notices: DataFrame, today: str | Column, within: int = 45) -> DataFrame:
    """Label of each instrument's earliest notice when it is today or within the days ahead."""
    day = _day(today)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    first = notices.groupBy("instrument_id").agg(F.min(F.struct("date", zero("cash"), zero("share_dividend"))).alias("e")).select("instrument_id", "e.*")
    soon = first.filter((F.col("date") >= day) & (F.col("date") <= F.date_add(day, within)))
    cash, share_dividend = F.col("cash") > 0, F.col("share_dividend") > 0
    kind = F.when(cash & share_dividend, "cash and shares").when(share_dividend, "shares").otherwise("cash")
    amount = F.when(cash, F.col("cash")).when(share_dividend, F.col("share_dividend"))
    shown = F.coalesce(F.concat(F.lit(" ("), F.regexp_replace(amount.cast("string"), r"\.0$", ""), F.lit(")")), F.lit(""))
    when = F.when(F.col("date") == day, "today").otherwise(_md("date"))
    return soon.select("instrument_id", "date", F.concat(F.lit("ex "), kind, F.lit(" "), when, shown).alias("ex_dividend"))
