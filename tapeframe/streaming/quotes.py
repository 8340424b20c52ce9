"""Structured Streaming over quotes: normalisation, price alerts, holding guard, day range.

``follow`` and ``follow_range`` go on where their last call ended: a folder holds the
stream's checkpoint, the state after each batch and what was delivered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import number_or_null, ratio
from ..session import cut_lineage, shared_folder
from ..sources.versions import Store

# How near a limit counts, and the jump in percent.
NEAR_UP, NEAR_DOWN, JUMP = 0.985, 1.015, 3.0


def read_quotes(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of raw quotes: symbol, ts, last trade or best bid as text.

    Every file of the landing folder that matches ``pattern`` is read, whenever it lands.
    Views carry no trade; their price is only a bid.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return raw_quotes(reader.parquet(folder))


def raw_quotes(events: DataFrame) -> DataFrame:
    text = F.col("value").cast("string")
    return events.select(
        F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "view", text).otherwise("-").alias("z"),
        F.concat(text, F.lit("_"), text).alias("b"),
    )


def prices(raw: DataFrame) -> DataFrame:
    """Symbol, ts, day and price: the last trade, else the best bid."""
    price = F.coalesce(number_or_null("z"), number_or_null(F.get(F.split("b", "_"), F.lit(0))))
    return raw.select("symbol", "ts", F.to_date("ts").alias("day"), price.alias("price"))


def carry_columns(priced: DataFrame) -> DataFrame:
    """Prices with the columns that ``carry`` adds, all null."""
    return priced.select("symbol", "ts", "day", "price", *[F.lit(None).cast("double").alias(c) for c in ("prev_close", "high", "low")])


STATE = "symbol long, day date, close double, before double, high double, low double"


def carry(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quotes of one trigger with previous close and running range, and the state after it.

    ``state`` has a row a symbol: its day, close, the close before that day, high and low.
    A quote that arrives after its day has passed gets neither and changes nothing.  Quotes
    are dealt out by ranges of (symbol, ts, price) and equal ones by a hash, so a symbol may
    fill many slices.  Hash aggregates find a row for each symbol, day and slice, and only
    these rows are carried from slice to slice and from day to day by windows.
    """
    known = F.when(~F.isnan("price"), F.col("price"))
    order = [F.col("ts").asc_nulls_last(), F.col("price").asc_nulls_last()]
    # stored, as another sample could cut other slices
    dealt = batch.withColumns({"price": known, "turn": F.xxhash64(F.monotonically_increasing_id())}).repartitionByRange("symbol", *order, "turn")
    rows = cut_lineage(dealt.withColumn("slice", F.spark_partition_id()).drop("turn"), "quote-slices")
    last = F.max(F.when(F.col("price").isNotNull(), F.struct("ts", "price")))["price"]
    parts = rows.filter("day IS NOT NULL").groupBy("symbol", "day", "slice").agg(F.max("price").alias("top"), F.min("price").alias("bottom"), last.alias("last"))
    was = state.select(F.col("symbol").alias("own"), *(F.col(c).alias(f"{c}_was") for c in ("day", "close", "before", "high", "low")))
    parts = parts.join(was, F.col("symbol").eqNullSafe(F.col("own")), "left").filter("day_was IS NULL OR day >= day_was")
    same, upto = F.col("day") == F.col("day_was"), Window.partitionBy("symbol", "day").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = {c: F.when(same, F.col(f"{c}_was")) for c in ("high", "low")}
    parts = parts.withColumns({"above": F.greatest(F.max("top").over(upto), first["high"]), "below": F.least(F.min("bottom").over(upto), first["low"])})

    closes = F.max_by("last", F.when(F.col("last").isNotNull(), F.col("slice"))).alias("last")
    once = [F.first(f"{c}_was").alias(f"{c}_was") for c in ("day", "close", "before", "high", "low")]
    days = parts.groupBy("symbol", "day").agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"), closes, *once)
    earlier = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("carried", F.coalesce(F.last("last", ignorenulls=True).over(earlier), "close_was"))
    days = cut_lineage(days.withColumn("prev_close", F.when(same, F.col("before_was")).otherwise(F.col("carried"))), "quote-days")

    seen = parts.select(F.col("symbol").alias("s"), F.col("day").alias("d"), F.col("slice").alias("k"), "above", "below")
    prev = days.select(F.col("symbol").alias("s"), F.col("day").alias("d"), "prev_close")
    marks = seen.join(prev, seen.s.eqNullSafe(prev.s) & (seen.d == prev.d)).select(seen.s, seen.d, "k", "above", "below", "prev_close")
    run = Window.partitionBy("slice", "symbol", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("symbol").eqNullSafe(F.col("s")) & (F.col("day") == F.col("d")) & (F.col("slice") == F.col("k"))
    timely = F.col("d").isNotNull()
    out = rows.join(marks, at, "left").select(
        "symbol", "ts", "day", "price", "prev_close",
        F.when(timely, F.greatest(F.max("price").over(run), "above")).alias("high"), F.when(timely, F.least(F.min("price").over(run), "below")).alias("low"),
    )
    newest = F.max_by(F.struct(
        F.col("day"), F.coalesce("last", "carried").alias("close"), F.col("prev_close").alias("before"),
        F.greatest("top", first["high"]).alias("high"), F.least("bottom", first["low"]).alias("low"),
    ), "day")
    changed = days.groupBy("symbol").agg(newest.alias("x")).select("symbol", "x.*")
    rest = state.join(changed.select(F.col("symbol").alias("own")), F.col("symbol").eqNullSafe(F.col("own")), "left_anti")
    return out, rest.unionByName(changed)


def normalised(quotes: DataFrame) -> DataFrame:
    """Carried quotes with limits and the change against the close of the symbol's previous quoted day.

    Quotes of a symbol without an earlier day keep a null change.
    """
    prev = F.col("prev_close")
    return quotes.select(
        "*", (prev * 1.1).alias("limit_up"), (prev * 0.9).alias("limit_down"),
        F.when(prev > 0, F.round(ratio(F.col("price") - prev, prev) * 100, 2)).alias("change_pct"),
    )


def alert_text(jump: float = JUMP) -> Column:
    p, c = F.col("price"), F.col("change_pct")
    return F.concat_ws(
        " ",
        F.when((F.col("limit_up") > 0) & (p >= F.col("limit_up") * NEAR_UP), "near-limit-up"),
        F.when((F.col("limit_down") > 0) & (p <= F.col("limit_down") * NEAR_DOWN), "near-limit-down"),
        F.when(c >= jump, "jump").when(c <= -jump, "drop"),
        F.when((F.col("high") > 0) & (p >= F.col("high")), "above-high"),
        F.when((F.col("low") > 0) & (p <= F.col("low")), "below-low"),
    )


def alerting(quotes: DataFrame, jump: float = JUMP) -> DataFrame:
    """Carried quotes that raise at least one alert."""
    return normalised(quotes).withColumn("alerts", alert_text(jump)).filter("alerts <> ''")


def holding_guard(priced: DataFrame, holdings: DataFrame, delay: str = "1 day") -> DataFrame:
    """One alert per holding and day when its stop or target is reached.

    State is dropped once the watermark passes, so it holds days, not history.
    """
    hit = priced.join(holdings, "symbol").filter((F.col("price") <= F.col("stop")) | (F.col("price") >= F.col("target")))
    return hit.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "day"]).select(
        "symbol", "day", "ts", "price", F.when(F.col("price") <= F.col("stop"), "stop hit").otherwise("target hit").alias("alert")
    )


def day_range(quotes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """High, low and number of quotes of each symbol and day, and its last time; a day is final once the watermark closes it."""
    return (
        quotes.withWatermark("ts", delay).groupBy("symbol", F.window("ts", "1 day"))
        .agg(F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        .select("symbol", F.to_date("window.start").alias("day"), "high", "low", "n", "last")
    )


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what has landed, exactly once, into files of the shared folder; returns them."""
    folder = shared_folder(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def in_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None], mode: str) -> None:
    """Hand what has landed since the last call to ``step``, batch by batch; ``folder`` keeps what has been seen."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def follow(raw: DataFrame, folder: str, then: Callable[[DataFrame], DataFrame] = normalised) -> DataFrame:
    """Quotes of ``raw`` through ``then``, as far as they have landed; all that was ever delivered to ``folder``.

    A call goes on where the last one ended, in this application or an earlier one: the
    symbols' closes and ranges are stored after each batch, under the batch's number.  A
    batch that is repeated finds its own state stored, or that of the batch before, and
    writes the same files again.
    """
    spark = raw.sparkSession
    done = f"{folder}/out"

    def step(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, f"{folder}/state")
        held = store.parts("state")
        if str(number) in held:
            return
        state = store.read("state", schema=STATE + ", batch long").drop("batch")
        quotes, after = carry(batch, state)
        then(quotes).write.mode("overwrite").parquet(f"{done}/batch={number}")
        store.commit({"state": (after.withColumn("batch", F.lit(number).cast("long")), "batch", [str(number)])}, drop={"state": list(held)})
        if number % 16 == 15:
            store.vacuum()

    source = prices(raw)
    in_batches(source, folder, step, "append")
    empty = spark.createDataFrame([], source.schema)
    shape = then(carry_columns(empty)).schema
    try:
        return spark.read.schema(shape).option("basePath", done).parquet(done)
    except AnalysisException:  # nothing has landed yet
        return spark.createDataFrame([], shape)


def follow_range(quotes: DataFrame, folder: str, delay: str = "10 minutes") -> DataFrame:
    """The range of every symbol and day so far, open days too, in a stored table; ``closed`` days do not change any more.

    Each batch delivers the days it changed, whole, and they replace the stored ones by
    symbol and day, so a repeated batch changes nothing.  Only these days are rewritten.
    """
    store, columns = Store(quotes.sparkSession, f"{folder}/ranges"), ["symbol", "day", "high", "low", "n", "last"]
    shape = "symbol long, high double, low double, n long, last timestamp, day date"

    def step(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, f"{folder}/ranges")
        new = cut_lineage(batch.filter("day IS NOT NULL"), "ranges")
        days = [str(r.day) for r in new.select("day").distinct().collect()]
        both = own.read("ranges", days, shape).withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
        newest = both.groupBy("symbol", "day").agg(F.max_by(F.struct("high", "low", "n", "last"), "turn").alias("x")).select("symbol", "x.*", "day")
        own.commit({"ranges": (newest, "day", days)})

    in_batches(day_range(quotes, delay), folder, step, "update")
    table = store.read("ranges", schema=shape).select(*columns)
    seen = table.agg((F.max("last") - F.expr(f"interval {delay}")).alias("t")).select("t").scalar()
    return table.withColumn("closed", F.coalesce(F.date_add("day", 1).cast("timestamp") <= seen, F.lit(False)))
