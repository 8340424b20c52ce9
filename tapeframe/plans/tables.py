"""Table maintenance, calendar and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..session import cut_lineage, shared_folder
from ..sources import calendar as cal
from ..sources import tables
from ..sources.landing import MarketTables
from ..sources.versions import Store
from ..streaming import quotes
from .brokers import FOLLOW, TOP, P
from .registry import query

CUT = "2001-01-01"


@query("trading_calendar", "SELECT date, idx, age, prev_date, next_date, n_dates FROM d_cal")
def trading_calendar(m: MarketTables) -> DataFrame:
    return m.calendar


@query("bars", "SELECT * FROM d_bars")
def bars(m: MarketTables) -> DataFrame:
    return m.bars


@query("panel_from_flows", "SELECT * FROM d_flow")
def panel_from_flows(m: MarketTables) -> DataFrame:
    return m.flow_panel


@query("slice_panel", "SELECT * FROM d_bars WHERE date BETWEEN DATE '1998-01-05' AND DATE '1998-12-28'")
def slice_panel(m: MarketTables) -> DataFrame:
    return tables.slice_panel(m.bars, "1998-01-05", "1998-12-28")


@query(
    "gap_days", "SELECT date FROM d_cal WHERE date NOT IN (SELECT date FROM d_sbl WHERE sbl_balance >= 130)",
)
def gap_days(m: MarketTables) -> DataFrame:
    return cal.gap_days(m.calendar, m.sbl.filter("sbl_balance >= 130"))


@query("latest_date_rows", "SELECT * FROM d_hold WHERE date = (SELECT max(date) FROM d_hold)")
def latest_rows(m: MarketTables) -> DataFrame:
    return cal.on_latest_date(m.big_holders, m.newest_of("big_holders"))


ISLANDS = {
    "i_have": "SELECT DISTINCT instrument_id, date, idx FROM d_sbl JOIN d_cal USING (date) WHERE sbl_balance >= 130",
    "i_runs": """SELECT instrument_id, min(idx) AS lo, max(idx) AS hi FROM (SELECT instrument_id, idx, idx - row_number() OVER (PARTITION BY instrument_id ORDER BY idx) AS run FROM i_have)
        GROUP BY instrument_id, run""",
}


def loaded_runs(m: MarketTables) -> DataFrame:
    """Islands of two deliveries that overlap, merged on insert."""
    have = m.sbl.filter("sbl_balance >= 130")
    edge = F.lit("1998-06-01").cast("date")
    first = cal.date_islands(have.filter(F.col("date") <= edge), m.calendar, "instrument_id")
    return cal.merge_islands(first.unionByName(cal.date_islands(have.filter(F.col("date") >= F.date_sub(edge, 70)), m.calendar, "instrument_id")), "instrument_id")


@query("loaded_islands", "SELECT r.instrument_id, a.date AS from_date, b.date AS to_date FROM i_runs r JOIN d_cal a ON a.idx = lo JOIN d_cal b ON b.idx = hi", **ISLANDS)
def loaded_islands(m: MarketTables) -> DataFrame:
    ends = [m.calendar.select(F.col("idx").alias(i), F.col("date").alias(d)) for i, d in (("lo", "from_date"), ("hi", "to_date"))]
    return loaded_runs(m).join(ends[0], "lo").join(ends[1], "hi").select("instrument_id", "from_date", "to_date")


@query(
    "instrument_gap_days",
    "SELECT instrument_id, date FROM (SELECT DISTINCT instrument_id FROM i_have) CROSS JOIN d_cal ANTI JOIN i_have USING (instrument_id, date)", **ISLANDS,
)
def instrument_gap_days(m: MarketTables) -> DataFrame:
    """Missing dates of each instrument from its islands: no row of the table is looked at again."""
    gaps = cal.island_gaps(loaded_runs(m), m.calendar, "instrument_id")
    return cal.dates_of_runs(gaps, m.calendar, "instrument_id").select("instrument_id", "date")


@query("last_n_rows", "SELECT instrument_id, date, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM d_bars) WHERE k <= 5")
def last_rows(m: MarketTables) -> DataFrame:
    from ..functions.windows import newest_first, top_rows

    return top_rows(m.bars.select("instrument_id", "date", "close"), newest_first("instrument_id"), 5).drop("rank")


def revised(m: MarketTables) -> DataFrame:
    """A later delivery: the last year again with corrected volumes."""
    return m.bars.filter(F.col("date") >= F.lit(CUT).cast("date")).withColumn("volume", F.col("volume") + 1)


UPSERTED = f"SELECT instrument_id, date, open, high, low, close, CASE WHEN date >= DATE '{CUT}' THEN volume + 1 ELSE volume END AS volume FROM d_bars"


@query("merge_incremental", UPSERTED)
def merge_incremental(m: MarketTables) -> DataFrame:
    return tables.merge(m.bars, revised(m), ["instrument_id", "date"])


@query("last_writer_wins", UPSERTED)
def last_writer(m: MarketTables) -> DataFrame:
    both = m.bars.withColumn("load_seq", F.lit(1)).unionByName(revised(m).withColumn("load_seq", F.lit(2)))
    return tables.latest(both, ["instrument_id", "date"], "load_seq").drop("load_seq")


@query("upsert_partitions", UPSERTED)
def upsert(m: MarketTables) -> DataFrame:
    """A stored table partitioned by date, then an upsert that rewrites the revised dates."""
    path = shared_folder(m.spark, "bars")
    tables.write_dates(m.bars, path)
    tables.upsert(path, revised(m), ["instrument_id", "date"])
    return tables.read_table(m.spark, path, "instrument_id", "date", "open", "high", "low", "close", "volume")


@query("rolling_retention", "SELECT * FROM d_margin WHERE date IN (SELECT date FROM d_cal WHERE age <= 60)")
def retention(m: MarketTables) -> DataFrame:
    return tables.retain(m.margin, 60)


@query(
    "dump_and_load_history", "SELECT CAST(instrument_id AS VARCHAR) AS instrument_id, date, margin_balance, short_balance FROM d_margin WHERE date IN (SELECT date FROM d_cal WHERE age <= 60)",
)
def history(m: MarketTables) -> DataFrame:
    path = shared_folder(m.spark, "history")
    loads = m.margin.withColumn("seq", F.lit(1)).unionByName(m.margin.withColumns({"margin_balance": F.lit(0.0), "seq": F.lit(0)}))
    tables.dump_history(loads, path, ["instrument_id", "date"], "seq", keep=60)
    return tables.load_history(m.spark, path, "instrument_id string, date date, margin_balance double, short_balance double")


@query("prune_stored", "SELECT * FROM d_margin WHERE date IN (SELECT date FROM d_cal WHERE age <= 60)")
def prune_stored(m: MarketTables) -> DataFrame:
    """A stored table cut down to its newest dates in place, twice."""
    path = shared_folder(m.spark, "pruned")
    tables.write_dates(m.margin, path)
    for _ in range(2):
        tables.prune(path, m.spark, 60)
    return tables.read_table(m.spark, path, *m.margin.columns)


@query(
    "broker_profile_stored", "SELECT * FROM b_profile", **FOLLOW,
)
def profile_stored(m: MarketTables) -> DataFrame:
    """Nets delivered in two parts and the second one folded twice; a fold reads the dates that are new."""
    path, nets = shared_folder(m.spark, "broker-counters"), shared_folder(m.spark, "broker-nets")
    split = F.lit("1998-06-01").cast("date")
    for delivery in (m.broker_net.filter(F.col("date") < split), m.broker_net.filter(F.col("date") >= split), None):
        if delivery is not None:
            tables.write_dates(delivery, nets)
        counters = tables.fold_stored_counters(path, Store(m.spark, nets), m.calendar, TOP)
    return tables.profile_from_counters(counters, P)


@query("broker_profile_update", "SELECT * FROM b_profile", **FOLLOW)
def profile_update(m: MarketTables) -> DataFrame:
    """Two deliveries folded in, the second one twice."""
    first = m.broker_net.filter(F.col("date") < F.lit("1998-06-01").cast("date"))
    counters, ledger = tables.empty_counters(m.spark)
    for nets in (first, m.broker_net, m.broker_net):
        counters, ledger = tables.fold_broker_counters(counters, ledger, nets, m.calendar, TOP)
        counters, ledger = cut_lineage(counters, "counters"), cut_lineage(ledger, "ledger")
    return tables.profile_from_counters(counters, P)


@query(
    "last_date_on_or_before",
    """SELECT label, (SELECT max(date) FROM d_cal WHERE date <= label) AS ref_date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS label FROM orders)""",
)
def last_date(m: MarketTables) -> DataFrame:
    labels = m.raw("orders").select(F.to_date("o_orderdate").alias("label")).distinct()
    return joins.last_date_on_or_before(labels, m.calendar).select("label", "ref_date")


# ---- streaming -----------------------------------------------------------

Q_TABLES = {
    "q_daily": "SELECT user_id AS symbol, CAST(ts AS DATE) AS day, last(value ORDER BY ts, value) AS c FROM events GROUP BY ALL",
    "q_prev": "SELECT symbol, day, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS prev_close FROM q_daily",
    "q_quotes": """SELECT symbol, ts, day, value AS price, prev_close, prev_close * 1.1e0 AS limit_up, prev_close * 0.9e0 AS limit_down,
        max(value) OVER w AS high, min(value) OVER w AS low,
        CASE WHEN prev_close > 0 THEN round((value - prev_close) / prev_close * 100, 2) END AS change_pct
        FROM (SELECT user_id AS symbol, ts, CAST(ts AS DATE) AS day, value FROM events) JOIN q_prev USING (symbol, day)
        WINDOW w AS (PARTITION BY symbol, day ORDER BY ts, value ROWS UNBOUNDED PRECEDING)""",
}
Q_COLUMNS = ("symbol", "day", "price", "prev_close", "high", "low", "limit_up", "limit_down", "change_pct")


def followed(m: MarketTables, name: str, then) -> DataFrame:
    return quotes.follow(quotes.read_quotes(m.spark, m.path), shared_folder(m.spark, name), then)


@query("quote_normalise", f"SELECT {', '.join(Q_COLUMNS)} FROM q_quotes", **Q_TABLES)
def quote_normalise(m: MarketTables) -> DataFrame:
    return followed(m, "quotes", lambda q: quotes.normalised(q).select(*Q_COLUMNS)).select(*Q_COLUMNS)


@query(
    "quote_alerts",
    """SELECT symbol, day, price, alerts FROM (SELECT *, concat_ws(' ', CASE WHEN limit_up > 0 AND price >= limit_up * 0.985 THEN 'near-limit-up' END,
         CASE WHEN limit_down > 0 AND price <= limit_down * 1.015 THEN 'near-limit-down' END, CASE WHEN change_pct >= 3 THEN 'jump' WHEN change_pct <= -3 THEN 'drop' END,
         CASE WHEN high > 0 AND price >= high THEN 'above-high' END, CASE WHEN low > 0 AND price <= low THEN 'below-low' END) AS alerts FROM q_quotes) WHERE alerts <> ''""",
    **Q_TABLES,
)
def quote_alerts(m: MarketTables) -> DataFrame:
    columns = ["symbol", "day", "price", "alerts"]
    return followed(m, "alerts", lambda q: quotes.alerting(q).select(*columns)).select(*columns)


def watched(m: MarketTables) -> DataFrame:
    """A position per symbol: stop and target from its mean price."""
    return m.raw("events").groupBy(F.col("user_id").alias("symbol")).agg(
        (F.round(F.avg("value"), 2) * 0.02).alias("stop"), (F.round(F.avg("value"), 2) * 3.0).alias("target")
    )


@query(
    "holding_guard",
    """SELECT DISTINCT symbol, day FROM q_quotes JOIN (SELECT user_id AS symbol, round(avg(value), 2) AS a FROM events GROUP BY 1) USING (symbol)
       WHERE price <= a * 0.02 OR price >= a * 3""", **Q_TABLES,
)
def holding_guard(m: MarketTables) -> DataFrame:
    """Alerted (symbol, day) pairs: which of a day's quotes came first is not compared."""
    return quotes.run_available(quotes.holding_guard(quotes.prices(quotes.read_quotes(m.spark, m.path)), watched(m)).select("symbol", "day"), "guard")


@query(
    "intraday_running_high_low",
    """SELECT user_id AS symbol, CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low, count(*) AS n FROM events
       WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def day_range(m: MarketTables) -> DataFrame:
    """Only days the watermark has closed are final."""
    return bid_range(m).filter("closed").drop("closed", "last")


@query(
    "intraday_open_range",
    """SELECT user_id AS symbol, CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low, count(*) AS n,
         CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AS closed FROM events GROUP BY ALL""",
)
def open_range(m: MarketTables) -> DataFrame:
    """The ranges of open days as well, and which are final."""
    return bid_range(m).drop("last")


def bid_range(m: MarketTables) -> DataFrame:
    stream = quotes.read_quotes(m.spark, m.path).withColumn("price", quotes.number_or_null(F.get(F.split("b", "_"), F.lit(0))))
    return quotes.follow_range(stream, shared_folder(m.spark, "range"))
