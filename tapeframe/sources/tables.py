"""Stored tables: last-writer-wins merges, rolling retention, history files, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Broker
from ..operators import brokers, joins
from ..session import cut_lineage
from .calendar import trading_calendar
from .versions import Store


TABLE = "rows"


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A stored table; columns that were added later are null in older dates."""
    df = Store(spark, path).read(TABLE)
    return df.select(*columns) if columns else df


def newest_rows(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The rows of a stored table's newest date, which the manifest names: no other date is opened."""
    store = Store(spark, path)
    df = store.read(TABLE, [max(store.parts(TABLE))])
    return df.select(*columns) if columns else df


def slice_panel(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Inclusive date range; literal bounds prune date partitions and row groups."""
    if lo is not None:
        df = df.filter(F.col("date") >= F.lit(lo).cast("date"))
    if hi is not None:
        df = df.filter(F.col("date") <= F.lit(hi).cast("date"))
    return df


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union where a new row replaces the old row of its key; missing columns become null.

    ``new`` must be unique per key, see ``latest``.  Old rows are only anti-joined, never
    sorted.
    """
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last loaded row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def dates_of(df: DataFrame) -> list[str]:
    """The dates of ``df`` as text, one value each."""
    return [str(r.date) for r in df.select("date").distinct().collect()]


def write_dates(df: DataFrame, path: str) -> None:
    """Store the dates present in ``df`` in place of those stored before; other dates stay."""
    Store(df.sparkSession, path).commit({TABLE: (df, "date")})


def upsert(path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Merge new rows into a stored table, reading and writing only their dates."""
    store = Store(new.sparkSession, path)
    dates = dates_of(new)
    touched = store.read(TABLE, dates, new.schema)
    store.commit({TABLE: (merge(touched, new, keys), "date", dates)})


def retain(df: DataFrame, keep: int) -> DataFrame:
    """Rows on the ``keep`` newest dates of the table itself."""
    oldest = trading_calendar(df).filter(F.col("age") <= keep).agg(F.min("date").alias("d")).select("d").scalar()
    return df.filter(F.col("date") >= oldest)


def replace_table(df: DataFrame, path: str) -> None:
    """Store ``df``, which may be read from the same table, in place of all that is stored."""
    store = Store(df.sparkSession, path)
    store.commit({TABLE: (df, "date")}, drop={TABLE: list(store.parts(TABLE))})


def prune(path: str, spark: SparkSession, keep: int) -> None:
    """Keep the newest dates of a stored table; the others are forgotten, no row is read or written."""
    store = Store(spark, path)
    store.commit({}, drop={TABLE: sorted(store.parts(TABLE))[:-keep]})


def record_day(path: str, picks: DataFrame) -> None:
    """Store a day's picks; a day that is stored already is replaced, the others stay."""
    write_dates(picks, path)


def dump_history(df: DataFrame, path: str, keys: Sequence[str], seq: str, keep: int | None = None) -> None:
    """Compressed text history: last row per key, newest dates only, ordered by key."""
    out = latest(df, keys, seq).drop(seq)
    if keep is not None:
        out = retain(out, keep)
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("header", True).option(
        "compression", "gzip"
    ).csv(path)


def load_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Text history with its fixed schema; ids stay text where the schema says so."""
    return spark.read.schema(schema).option("header", True).csv(path)


# ---- additive broker counters ---------------------------------------------

COUNTERS = "broker string, instrument_id long, ops long, flips long, bought double, dumped double"
LEDGER = "instrument_id long, date date"
NETS = "instrument_id long, date date, broker string, net double"
SUMS = ("ops", "flips", "bought", "dumped")


def empty_counters(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], COUNTERS), spark.createDataFrame([], LEDGER)


def broker_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("broker", "instrument_id").agg(
        F.count(F.lit(1)).alias("ops"), F.sum("flip").alias("flips"), F.sum("bought").alias("bought"), F.sum("dumped").alias("dumped"),
    )


def summed(counters: DataFrame, *more: str) -> DataFrame:
    """Counters of one row for each broker and instrument."""
    return counters.groupBy("broker", "instrument_id", *more).agg(*[F.sum(c).alias(c) for c in SUMS])


def fold_broker_counters(
    counters: DataFrame, ledger: DataFrame, nets: DataFrame, calendar: DataFrame, top: int = 15
) -> tuple[DataFrame, DataFrame]:
    """Add the pairs not folded yet; running it twice changes nothing.

    Counters are kept per (broker, instrument): sums merge by key and the number of instruments
    is a count of rows, so no broker carries a growing list.  Brokers are ranked and paired
    only from the oldest date on that the ledger lacks.
    """
    steps = cut_lineage(brokers.adjacent_steps(nets, calendar).join(ledger, ["instrument_id", "date"], "left_anti"), "steps")
    oldest = steps.agg(F.min("date").alias("d")).first().d
    if oldest is None:
        return counters, ledger
    pairs = brokers.follow_up(nets.filter(F.col("date") >= F.lit(oldest)), steps, top)
    merged = summed(counters.unionByName(broker_counts(pairs)))
    return merged, ledger.unionByName(steps.select("instrument_id", "date"))


BUCKETS, DELTAS = 16, 8


def fold_stored_counters(path: str, nets: Store, calendar: DataFrame, top: int = 15) -> DataFrame:
    """Fold the dates of ``nets`` that are new or were written anew into the counters under ``path``; returns these.

    ``nets`` stores broker nets by date as ``rows``.  Its manifest against the marks of the
    last fold tells the changed dates, so a fold reads only these, the dates next to them
    and their part of the ledger.  What it adds is a delta of its own; after ``DELTAS`` of
    them the counters' buckets that they touch are written anew.  Ledger, marks and counters
    change together, in one commit, so a fold that is interrupted or repeated adds nothing twice.
    """
    spark, store = nets.spark, Store(nets.spark, path)
    marks = {str(r.date): r.place for r in store.read("marks", schema="date date, place long, mark int").collect()}
    places = nets.parts(TABLE)
    changed = {d for d, place in places.items() if marks.get(d) != place}
    if changed:
        # a step is read if it starts or ends on a changed date and both its dates are stored
        around = calendar.select(*[F.col(c).cast("string") for c in ("date", "next_date")]).collect()
        steps_at = {r.date: r.next_date for r in around if r.date in places and r.next_date in places and {r.date, r.next_date} & changed}
        starts = set(steps_at)
        near = nets.read(TABLE, sorted(starts | set(steps_at.values())), NETS)
        today = near.filter(F.col("date").cast("string").isin(sorted(starts)))
        ledger = store.read("ledger", sorted(starts), LEDGER)
        present = near.select("instrument_id", "date").distinct()
        steps = joins.next_date_pairs(today.select("instrument_id", "date").distinct(), present, calendar, ["instrument_id"], "inner")
        steps = cut_lineage(steps.join(ledger, ["instrument_id", "date"], "left_anti"), "steps")
        delta = broker_counts(brokers.follow_up(near, steps, top))
        number = store.manifest()[0] + 1
        deltas, known = store.parts("deltas"), set(store.parts("counters"))
        delta = cut_lineage(delta.withColumn("delta", F.lit(number)), "delta")
        new = spark.createDataFrame([(d, p) for d, p in places.items()], "date string, place long").select(F.col("date").cast("date").alias("date"), "place", F.lit(0).alias("mark"))
        folded = dates_of(steps)
        full = ledger.filter(F.col("date").cast("string").isin(folded)).unionByName(steps.select("instrument_id", "date"))
        commit, drop = {"marks": (new, "mark", ["0"]), "ledger": (full, "date", folded)}, {}
        if len(deltas) + 1 < DELTAS:
            commit["deltas"] = (delta, "delta", [str(number)] if folded else [])
        else:
            bucket = F.pmod(F.xxhash64("broker", "instrument_id"), F.lit(BUCKETS)).cast("int")
            added = cut_lineage(store.read("deltas", schema=COUNTERS + ", delta int").unionByName(delta).drop("delta").withColumn("bucket", bucket), "deltas")
            touched = {str(r.bucket) for r in added.select("bucket").distinct().collect()} & known
            base = store.read("counters", sorted(touched), COUNTERS + ", bucket int")
            commit["counters"] = (summed(base.unionByName(added), "bucket"), "bucket")
            drop["deltas"] = list(deltas)
        store.commit(commit, drop)
    both = store.read("counters", schema=COUNTERS + ", bucket int").drop("bucket").unionByName(store.read("deltas", schema=COUNTERS + ", delta int").drop("delta"))
    return summed(both)


def profile_from_counters(counters: DataFrame, p: Broker = Broker()) -> DataFrame:
    total = counters.groupBy("broker").agg(
        *[F.sum(c).alias(c) for c in ("ops", "flips", "bought", "dumped")], F.count(F.lit(1)).alias("n_instruments")
    )
    return brokers.profile_rates(total, p)
