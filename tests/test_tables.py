from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeframe.config import Broker
from tapeframe.operators import brokers
from tapeframe.session import shared_folder
from tapeframe.sources import calendar, normalize, tables
from tapeframe.sources.versions import Store
from tapeframe.streaming import quotes

from .conftest import days

PRICE = "instrument_id long, date date, close double"


def test_upsert_touches_only_its_dates_and_is_repeatable(spark, frame):
    d = days(3)
    path = shared_folder(spark, "t")
    tables.write_dates(frame(PRICE, *[(s, x, 1.0) for s in (1, 2) for x in d]), path)
    new = frame(PRICE, (1, d[1], 9.0), (3, d[1], 7.0), (1, days(4)[3], 5.0))
    results = []
    for _ in range(2):
        tables.upsert(path, new, ["instrument_id", "date"])
        results.append(sorted((r.instrument_id, r.date, r.close) for r in tables.read_table(spark, path, "instrument_id", "date", "close").collect()))
    assert results[0] == results[1] and len(results[0]) == 8
    assert (1, d[1], 9.0) in results[0] and (2, d[1], 1.0) in results[0] and (1, d[0], 1.0) in results[0]


def test_merge_keeps_added_columns(frame):
    d = days(1)[0]
    old = frame(PRICE, (1, d, 1.0), (2, d, 2.0))
    new = frame(PRICE + ", volume long", (1, d, 5.0, 10))
    got = {r.instrument_id: (r.close, r.volume) for r in tables.merge(old, new, ["instrument_id", "date"]).collect()}
    assert got == {1: (5.0, 10), 2: (2.0, None)}


def test_retention_and_slices(frame):
    df = frame(PRICE, *[(1, x, 1.0) for x in days(10)])
    assert {r.date for r in tables.retain(df, 3).collect()} == set(days(10)[-3:])
    assert tables.slice_panel(df, str(days(3)[2]), str(days(5)[4])).count() == 3


def test_calendar_edges(frame):
    d = days(4)
    cal = calendar.trading_calendar(frame("date date", (d[0],), (d[1],), (d[3],), (d[1],)))
    rows = {r.date: r for r in cal.collect()}
    assert rows[d[1]].next_date == d[3] and rows[d[3]].next_date is None and rows[d[0]].age == 3
    assert [r.date for r in calendar.gap_days(cal, frame("date date", (d[0],), (d[3],))).collect()] == [d[1]]


def test_history_keeps_text_ids(spark, frame):
    d = days(2)
    rows = [("0050", d[0], 1.0, 1), ("0050", d[0], 2.0, 2), ("1101", d[1], 3.0, 1)]
    path = shared_folder(spark, "h")
    tables.dump_history(frame("instrument_id string, date date, close double, seq int", *rows), path, ["instrument_id", "date"], "seq")
    got = sorted((r.instrument_id, r.close) for r in tables.load_history(spark, path, "instrument_id string, date date, close double").collect())
    assert got == [("0050", 2.0), ("1101", 3.0)]


def test_normalised_quotes(frame):
    raw = frame(
        "code string, day string, open string, high string, low string, close string, shares string",
        ("1101", "115/08/10", "1,000.5", "1,010", "990", "--", "12,999"), ("1101", "bad", "1", "1", "1", "1", "1"),
    )
    rows = normalize.normalize_quotes(raw).collect()
    assert len(rows) == 1 and (rows[0].open, rows[0].close, rows[0].volume) == (1000.5, 0.0, 12)


@pytest.fixture
def ticks(spark, frame):
    rows = [
        (1, "2024-01-01 10:00:00", "buy", 100.0), (1, "2024-01-02 09:00:00", "buy", 109.0), (1, "2024-01-02 09:05:00", "view", 90.5),
        (1, "2024-01-02 09:06:00", "buy", 108.9), (1, "2024-01-04 09:00:00", "buy", 100.0),
    ]
    df = frame("user_id long, ts string, event_type string, value double", *rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    folder = shared_folder(spark, "ticks")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder, df


def stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return quotes.raw_quotes(spark.readStream.schema(schema).parquet(f"{folder}/events.parquet"))


def test_alerts_and_single_guard(spark, frame, ticks):
    folder, _ = ticks
    alerts = {(r.day.day, r.price): r.alerts for r in quotes.follow(stream(spark, folder), shared_folder(spark, "a"), quotes.alerting).collect()}
    assert alerts == {
        (1, 100.0): "above-high below-low", (2, 109.0): "near-limit-up jump above-high below-low", (2, 90.5): "near-limit-down drop below-low",
        (2, 108.9): "near-limit-up jump", (4, 100.0): "drop above-high below-low",
    }
    held = frame("symbol long, stop double, target double", (1, 95.0, 105.0))
    guard = quotes.run_available(quotes.holding_guard(quotes.prices(stream(spark, folder)), held), "g").collect()
    assert len(guard) == 1 and str(guard[0].day) == "2024-01-02"


def test_first_day_of_a_symbol_is_guarded(spark, frame, ticks):
    folder, _ = ticks
    held = frame("symbol long, stop double, target double", (1, 100.0, 900.0))
    guard = quotes.run_available(quotes.holding_guard(quotes.prices(stream(spark, folder)), held), "g").collect()
    assert "2024-01-01" in {str(r.day) for r in guard}


def test_later_deliveries_continue_the_day(spark, frame):
    """A second file under another name is seen; the close and range of the first carry over."""
    folder = shared_folder(spark, "landing")
    schema = "user_id long, ts string, event_type string, value double"

    def deliver(n, *rows):
        frame(schema, *rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events-{n}.parquet")

    deliver(1, (1, "2024-01-01 10:00:00", "buy", 100.0), (1, "2024-01-02 09:00:00", "buy", 104.0), (2, "2024-01-02 09:00:00", "buy", 7.0))
    deliver(2, (1, "2024-01-02 09:30:00", "buy", 103.0), (1, "2024-01-01 11:00:00", "buy", 300.0), (2, "2024-01-03 09:00:00", "buy", 8.0))
    raw = quotes.raw_quotes(spark.readStream.schema(spark.read.parquet(f"{folder}/events-1.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events-*.parquet"))
    got = {(r.symbol, r.price): (r.prev_close, r.high, r.low) for r in quotes.follow(raw, shared_folder(spark, "n")).collect()}
    assert got == {
        (1, 100.0): (None, 100.0, 100.0), (1, 104.0): (100.0, 104.0, 104.0), (2, 7.0): (None, 7.0, 7.0),
        (1, 103.0): (100.0, 104.0, 103.0), (1, 300.0): (None, None, None), (2, 8.0): (7.0, 8.0, 8.0),
    }


def test_a_symbol_of_many_slices(spark, monkeypatch):
    """Quotes of one symbol are dealt over many tasks, none of them in Python, and carry over slices, days and triggers."""
    rng = random.Random(4)
    at = lambda day, s: datetime(2024, 1, day, 9) + timedelta(seconds=s)
    make = lambda days, n: [(rng.choice([1, 1, 1, 2, None]), t := at(rng.choice(days), rng.randrange(40)), t.date(), rng.choice([None, float(rng.randrange(90))])) for _ in range(n)]
    triggers = [make([3, 4, 5], 300) + [(7, at(3, 0), at(3, 0).date(), None)], make([4, 5, 6], 300), make([2, 6, 7], 300) + [(7, at(4, 0), at(4, 0).date(), 5.0), (1, None, None, 3.0)]]
    stored, slices = quotes.cut_lineage, []

    def uncoalesced(df, name):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = stored(df, name)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        if name == "quote-slices":
            slices.append(table.filter("symbol = 1").select("slice").distinct().count())
        return table

    monkeypatch.setattr(quotes, "cut_lineage", uncoalesced)
    state, kept = spark.createDataFrame([], quotes.STATE), {}
    number = lambda x: float("inf") if x is None else x
    for rows in triggers:
        frame = spark.createDataFrame(rows, "symbol long, ts timestamp, day date, price double")
        out, state = quotes.carry(frame, state)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan
        got, state, want = [tuple(r) for r in out.collect()], stored(state, "state"), []
        for r in sorted(rows, key=lambda r: (r[1] or datetime.max, number(r[3]))):
            symbol, _, day, price = r
            now = kept.setdefault(symbol, [None] * 5)
            if day is None or now[0] and day < now[0]:
                want.append((*r, None, None, None))
                continue
            if day != now[0]:
                now[:] = day, now[1], now[1], None, None
            if price is not None:
                now[1], now[3], now[4] = price, max(price, number(now[3]) if now[3] is not None else price), min(price, number(now[4]))
            want.append((*r, *now[2:]))
        assert Counter(got) == Counter(want)
        assert {r.symbol: list(r)[1:] for r in state.collect()} == {k: v for k, v in kept.items() if v[0]}
    assert min(slices) > 1


def landing(spark, frame):
    """A folder, and a function that lands a file of quotes in it."""
    folder = shared_folder(spark, "landing")
    schema = "user_id long, ts string, event_type string, value double"

    def deliver(n, *rows):
        frame(schema, *rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events-{n}.parquet")

    return folder, deliver


def landed(spark, folder):
    shape = "user_id long, ts timestamp_ntz, event_type string, value double"
    return quotes.raw_quotes(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events-*.parquet"))


def test_a_second_call_goes_on_from_the_first(spark, frame):
    """New streams over the same folder: only new quotes are delivered, against the close and range that are stored."""
    folder, deliver = landing(spark, frame)
    at = shared_folder(spark, "followed")
    rows = lambda: {(r.symbol, r.price): (r.prev_close, r.high, r.low) for r in quotes.follow(landed(spark, folder), at).collect()}
    deliver(1, (1, "2024-01-01 10:00:00", "buy", 100.0), (1, "2024-01-02 09:00:00", "buy", 104.0))
    first = rows()
    assert first == {(1, 100.0): (None, 100.0, 100.0), (1, 104.0): (100.0, 104.0, 104.0)}
    files = set(spark.read.parquet(f"{at}/out").inputFiles())
    assert rows() == first and set(spark.read.parquet(f"{at}/out").inputFiles()) == files
    deliver(2, (1, "2024-01-02 09:30:00", "buy", 103.0), (2, "2024-01-02 09:00:00", "buy", 7.0))
    deliver(3, (2, "2024-01-03 09:00:00", "buy", 8.0))
    assert rows() == first | {(1, 103.0): (100.0, 104.0, 103.0), (2, 7.0): (None, 7.0, 7.0), (2, 8.0): (7.0, 8.0, 8.0)}
    assert files < set(spark.read.parquet(f"{at}/out").inputFiles())


def test_a_repeated_batch_changes_nothing(spark, frame, monkeypatch):
    folder, deliver = landing(spark, frame)
    at, steps = shared_folder(spark, "followed"), []
    run = quotes.in_batches
    monkeypatch.setattr(quotes, "in_batches", lambda stream, folder, step, mode: run(stream, folder, lambda df, n: (step(df, n), steps.append(n), step(df, n)) and None, mode))
    deliver(1, (1, "2024-01-01 10:00:00", "buy", 100.0))
    deliver(2, (1, "2024-01-02 09:00:00", "buy", 104.0))
    got = [(r.price, r.prev_close) for r in quotes.follow(landed(spark, folder), at).orderBy("ts").collect()]
    assert got == [(100.0, None), (104.0, 100.0)] and steps == [0, 1]


def test_a_batch_that_stopped_before_its_commit_is_done_again(spark, frame, monkeypatch):
    folder, deliver = landing(spark, frame)
    at = shared_folder(spark, "followed")
    deliver(1, (1, "2024-01-01 10:00:00", "buy", 100.0))
    quotes.follow(landed(spark, folder), at)
    deliver(2, (1, "2024-01-02 09:00:00", "buy", 104.0))

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(Store, "publish", stop)
        with pytest.raises(Exception, match="stopped"):
            quotes.follow(landed(spark, folder), at)
    got = [(r.price, r.prev_close) for r in quotes.follow(landed(spark, folder), at).orderBy("ts").collect()]
    assert got == [(100.0, None), (104.0, 100.0)]


def test_open_days_are_delivered_revised_and_closed(spark, frame):
    folder, deliver = landing(spark, frame)
    at = shared_folder(spark, "ranges")

    def ranges():
        raw = landed(spark, folder).withColumn("price", quotes.number_or_null(F.get(F.split("b", "_"), F.lit(0))))
        return {(r.symbol, str(r.day)): (r.high, r.low, r.n, r.closed) for r in quotes.follow_range(raw, at).collect()}

    deliver(1, (1, "2024-01-01 10:00:00", "buy", 100.0), (None, "2024-01-01 10:00:00", "buy", 3.0))
    assert ranges() == {(1, "2024-01-01"): (100.0, 100.0, 1, False), (None, "2024-01-01"): (3.0, 3.0, 1, False)}
    deliver(2, (1, "2024-01-01 11:00:00", "buy", 90.0), (1, "2024-01-01 12:00:00", "view", 95.0), (None, "2024-01-01 10:30:00", "buy", 4.0))
    assert ranges() == {(1, "2024-01-01"): (100.0, 90.0, 3, False), (None, "2024-01-01"): (4.0, 3.0, 2, False)}
    deliver(3, (1, "2024-01-02 00:10:00", "buy", 91.0))
    assert ranges() == {(1, "2024-01-01"): (100.0, 90.0, 3, True), (None, "2024-01-01"): (4.0, 3.0, 2, True), (1, "2024-01-02"): (91.0, 91.0, 1, False)}
    assert ranges() == ranges()


def test_an_interrupted_write_leaves_the_old_table(spark, frame, monkeypatch):
    d, path = days(4), shared_folder(spark, "t")
    rows = lambda: sorted((r.instrument_id, r.date, r.close) for r in tables.read_table(spark, path, "instrument_id", "date", "close").collect())
    tables.write_dates(frame(PRICE, *[(s, x, 1.0) for s in (1, 2) for x in d]), path)
    before = rows()

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(Store, "publish", stop)
        for job in (
            lambda: tables.upsert(path, frame(PRICE, (1, d[1], 9.0)), ["instrument_id", "date"]), lambda: tables.prune(path, spark, 1),
            lambda: tables.replace_table(frame(PRICE, (5, d[0], 5.0)), path), lambda: tables.record_day(path, frame(PRICE, (5, d[0], 5.0))),
        ):
            with pytest.raises(RuntimeError):
                job()
            assert rows() == before
    tables.upsert(path, frame(PRICE, (1, d[1], 9.0)), ["instrument_id", "date"])
    assert rows() == sorted([r for r in before if r[:2] != (1, d[1])] + [(1, d[1], 9.0)])
    tables.prune(path, spark, 2)
    assert {r[1] for r in rows()} == set(d[2:])


def test_versions_share_parts_until_nothing_needs_them(spark, frame):
    d, path = days(3), shared_folder(spark, "t")
    store = Store(spark, path)
    assert store.manifest() == (-1, {}) and store.read("rows", schema=PRICE).count() == 0
    tables.write_dates(frame(PRICE, *[(1, x, 1.0) for x in d]), path)
    tables.record_day(path, frame(PRICE + ", volume long", (1, d[1], 2.0, 7)))
    assert store.parts("rows") == {str(d[0]): 0, str(d[1]): 1, str(d[2]): 0}
    got = {r.date: (r.close, r.volume) for r in tables.read_table(spark, path).collect()}
    assert got == {d[0]: (1.0, None), d[1]: (2.0, 7), d[2]: (1.0, None)}
    assert {f.split("/v__=")[1].split("/")[0] + f.split("date=")[1][:10] for f in tables.read_table(spark, path).inputFiles()} == {f"0{d[0]}", f"1{d[1]}", f"0{d[2]}"}
    assert [r.date for r in tables.newest_rows(spark, path).collect()] == [d[2]] and len(tables.newest_rows(spark, path).inputFiles()) == 1
    tables.replace_table(tables.read_table(spark, path).withColumn("close", F.col("close") + 1), path)
    assert store.vacuum(keep=2) == [] and len(store.vacuum(keep=1)) == 2 and store.vacuum(keep=9) == []
    assert sorted(r.close for r in tables.read_table(spark, path).collect()) == [2.0, 2.0, 3.0]
    tables.prune(path, spark, 0 + 1)
    tables.replace_table(tables.read_table(spark, path).limit(0), path)
    assert store.parts("rows") == {}


def test_a_fold_reads_the_new_date_and_its_neighbour_only(spark, frame, monkeypatch):
    """Reads by part; late rows and dates are found by the manifest; counters are compacted by bucket."""
    monkeypatch.setattr(tables, "DELTAS", 3)
    rng, d = random.Random(3), days(9)
    net = "instrument_id long, date date, broker string, net double"
    rows = [(s, x, b, float(rng.choice([-3, -1, 2, 4]))) for s in range(4) for x in d for b in "abc" if rng.random() < 0.8]
    cal = calendar.trading_calendar(frame("date date", *[(x,) for x in d]))
    nets, path, read = Store(spark, shared_folder(spark, "nets")), shared_folder(spark, "counters"), []
    plain = Store.read

    def watched(self, name, parts=None, schema=None):
        if parts is not None:
            read.append((name, list(parts)))
        return plain(self, name, parts, schema)

    monkeypatch.setattr(Store, "read", watched)
    deliveries = [[r for r in rows if r[1] in d[:4]], *[[r for r in rows if r[1] == x] for x in (d[4], d[6], d[5], d[7])], []]
    late = [(9, d[2], "a", 5.0), (9, d[3], "a", -2.0)]
    deliveries.append([r for r in rows + late if r[1] in (d[2], d[3])])
    deliveries.append([r for r in rows if r[1] == d[8]])
    for i, delivery in enumerate(deliveries):
        if delivery:
            tables.write_dates(frame(net, *delivery), nets.path)
        read.clear()
        counters = tables.fold_stored_counters(path, nets, cal)
        if i == 1:
            assert read == [("rows", [str(d[3]), str(d[4])]), ("ledger", [str(d[3])])]
        if not delivery:
            assert read == []
    want = brokers.broker_profile(frame(net, *rows, *late), cal, Broker(min_ops=1))
    assert {tuple(r) for r in tables.profile_from_counters(counters, Broker(min_ops=1)).collect()} == {tuple(r) for r in want.collect()}
    assert len(Store(spark, path).parts("counters")) > 0 and len(Store(spark, path).parts("deltas")) < 3


def test_kept_tables_outlive_a_reader_and_follow_their_sources(spark, tmp_path):
    from tapeframe.sources import landing
    from tapeframe.sources.landing import MarketTables, fingerprint, market

    folder = str(tmp_path / "sf")
    for name in landing.SOURCES:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    first = MarketTables(spark, folder)
    rows, files = first.panel.count(), sorted(first.panel.inputFiles())
    assert sorted(MarketTables(spark, folder).panel.inputFiles()) == files
    assert market(spark, folder) is market(spark, folder)
    before = market(spark, folder)
    mark = fingerprint(spark, folder)
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_shipdate", F.expr("l_shipdate + interval 9 year")).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    assert fingerprint(spark, folder) != mark and market(spark, folder) is before
    assert market(spark, folder, refresh=True) is not before and market(spark, folder) is not before
    assert MarketTables(spark, folder).panel.count() > rows


def test_one_join_of_the_facts(spark):
    """The daily report's notices and the sizing requests read stored tables, not lines or orders."""
    from tapeframe.sources.landing import market

    m = market(spark, "/root/testdata/sf0.001")
    for table in (m.restriction_notices, m.sizing_requests, m.broker_net, m.revenue, m.holder_tiers):
        assert not any("lineitem" in f or "orders.parquet" in f for f in table.inputFiles())


def test_islands_of_loaded_dates(frame):
    rng, d = random.Random(8), days(30)
    cal = calendar.trading_calendar(frame("date date", *[(x,) for x in d]))
    have = {(k, x) for k in range(5) for x in d if rng.random() < 0.6} | {(9, d[0]), (8, d[-1])} | {(7, x) for x in d}
    schema = "instrument_id long, date date"
    parts = [[r for r in sorted(have) if rng.random() < 0.5] for _ in range(3)]
    parts.append(sorted(have - set().union(*parts)))
    islands = None
    for rows in parts:
        new = calendar.date_islands(frame(schema, *rows, *rows[:2]), cal, "instrument_id")
        islands = calendar.merge_islands(new if islands is None else islands.unionByName(new), "instrument_id")
    runs = [tuple(r) for r in islands.collect()]
    assert sorted(runs) == sorted(tuple(r) for r in calendar.date_islands(frame(schema, *have), cal, "instrument_id").collect())
    gaps = calendar.dates_of_runs(calendar.island_gaps(islands, cal, "instrument_id"), cal, "instrument_id")
    assert sorted(tuple(r) for r in gaps.select("instrument_id", "date").collect()) == sorted({(k, x) for k, _ in have for x in d} - have)
    whole = calendar.merge_islands(calendar.date_islands(frame(schema, *have), cal).select("lo", "hi"))
    assert [tuple(r) for r in whole.collect()] == [(0, 29)]


def test_shuffles_start_with_partitions_for_the_files(spark, monkeypatch):
    """More files, more partitions, so a task's share does not grow; a higher number stays."""
    from tapeframe import session
    from tapeframe.sources import landing

    before = spark.conf.get(session.INITIAL_PARTITIONS, None)
    try:
        spark.conf.unset(session.INITIAL_PARTITIONS)
        size = landing.listing(spark, "/root/testdata/sf0.001")[1]
        landing.MarketTables(spark, "/root/testdata/sf0.001").look()
        assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
        monkeypatch.setattr(landing, "PARTITION_BYTES", size // 40)
        landing.market(spark, "/root/testdata/sf0.001", refresh=True)
        assert int(spark.conf.get(session.INITIAL_PARTITIONS)) >= 40
        spark.conf.set(session.INITIAL_PARTITIONS, "500")
        landing.market(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "500"
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS) if before is None else spark.conf.set(session.INITIAL_PARTITIONS, before)


def test_stored_weeks_cost_one_shuffle_of_the_lines(spark, monkeypatch):
    """Ranged lines are aggregated and sorted in place: one exchange for the panel, and none after the ranges of the nets."""
    from tapeframe.sources import landing

    plans = {}
    keep = landing.keep_table
    monkeypatch.setattr(landing, "keep_table", lambda df, key: plans.setdefault(key.rsplit("-", 1)[1], df._jdf.queryExecution().executedPlan().toString()) and keep(df, key))
    m = landing.MarketTables(spark, "/root/testdata/sf0.001", mark="one-shuffle")
    assert m.panel.count() > 0 and m.broker_net.count() > 0
    assert plans["panel"].count("Exchange ") == 1
    assert plans["broker_net"].split("Exchange rangepartitioning")[0].count("Exchange ") == 0


def test_stored_months_cost_one_shuffle_of_the_lines(spark, monkeypatch):
    """Ranged lines give months and their tiers in place; revenue and shares of tiers are read from them without a shuffle."""
    from tapeframe.sources import landing

    plans = {}
    keep = landing.keep_table
    monkeypatch.setattr(landing, "keep_table", lambda df, key: plans.setdefault(key.rsplit("-", 1)[1], df._jdf.queryExecution().executedPlan().toString()) and keep(df, key))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    m = landing.MarketTables(spark, "/root/testdata/sf0.001", mark="one-shuffle-months")
    rows, tiers = m.revenue.count(), m.holder_tiers.count()
    assert plans["monthly"].count("Exchange ") == 1 and "Exchange rangepartitioning" in plans["monthly"]
    assert "Exchange" not in plan(m.revenue) and "Exchange" not in plan(m.holder_tiers)
    assert m.monthly.select("instrument_id", "month").distinct().count() == rows == m.monthly.count() < tiers
    lazy = landing.MarketTables(spark, "/root/testdata/sf0.001", keep=False)
    for name in ("revenue", "holder_tiers", "quarter_sums"):
        assert sorted(map(tuple, getattr(m, name).collect())) == sorted(map(tuple, getattr(lazy, name).collect())), name


def test_broker_lines_are_dealt_out_with_one_name_and_number(frame):
    from tapeframe.sources.normalize import broker_net_from_trades

    seen = []
    t = frame("instrument_id long, date date, broker_id string, broker_name string, buy double, sell double", (1, days(1)[0], "7", None, 3000.0, 0.0), (1, days(1)[0], "7", None, 0.0, 1000.0), (1, None, "8", "x", None, 1.0))
    got = broker_net_from_trades(t, lambda rows: seen.append(rows.columns) or rows.repartition(3))
    assert seen == [["instrument_id", "date", "broker", "net"]]
    assert {tuple(r) for r in got.collect()} == {(1, days(1)[0], "7", 2.0), (1, None, "x", None)} == {tuple(r) for r in broker_net_from_trades(t).collect()}
