from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tapeframe.config import Broker, LockScreen
from tapeframe.functions.columns import pct_simple
from tapeframe.functions.windows import ordered
from tapeframe.operators import brokers, report, study, technical
from tapeframe.operators.joins import panel_from_flows
from tapeframe.session import cut_lineage
from tapeframe.sources import normalize, tables
from tapeframe.sources.calendar import trading_calendar

from .conftest import days

NETS = "instrument_id long, date date, broker string, net double"


@pytest.fixture
def two_days(frame):
    d1, d2 = days(2)
    rows = [(s, d1, b, 100.0) for s in range(6) for b in ("flip", "hold")]
    rows += [(s, d2, "flip", -80.0) for s in range(6)] + [(s, d2, "hold", 50.0) for s in range(6)]
    return frame(NETS, *rows), trading_calendar(frame("date date", (d1,), (d2,)))


def test_profile_separates_flippers_from_holders(two_days):
    nets, cal = two_days
    p = {r.broker: r for r in brokers.broker_profile(nets, cal, Broker(min_ops=5)).collect()}
    assert (p["flip"].flip_rate, p["flip"].dump_ratio, p["flip"].n_instruments, p["flip"].broker_class) == (100.0, 80.0, 6, "hot")
    assert (p["hold"].flip_rate, p["hold"].broker_class) == (0.0, "long")


def test_profile_needs_samples(two_days):
    nets, cal = two_days
    assert brokers.broker_profile(nets, cal, Broker(min_ops=7)).count() == 0


def test_profile_before_sees_nothing_on_the_sell_date(two_days):
    nets, cal = two_days
    assert brokers.broker_profile(nets, cal, Broker(min_ops=1), before=str(days(2)[1])).count() == 0
    assert brokers.broker_profile(nets, cal, Broker(min_ops=1), before=str(days(3)[2])).count() == 2


def test_gap_days_do_not_pair(frame):
    d = days(3)
    nets = frame(NETS, (1, d[0], "a", 10.0), (1, d[2], "a", -10.0))
    cal = trading_calendar(frame("date date", *[(x,) for x in d]))
    assert brokers.buyer_follow_up(nets, cal, 15).count() == 0
    assert brokers.follow_up(nets, brokers.available_steps(nets), 15).filter("flip = 1").count() == 1


def test_fold_is_idempotent(two_days, spark):
    nets, cal = two_days
    counters, ledger = tables.empty_counters(spark)
    counts = []
    for _ in range(2):
        counters, ledger = tables.fold_broker_counters(counters, ledger, nets, cal)
        counters, ledger = cut_lineage(counters, "c"), cut_lineage(ledger, "l")
        counts.append((sorted(map(tuple, counters.collect())), ledger.count()))
    assert counts[0] == counts[1]
    folded = {tuple(r) for r in tables.profile_from_counters(counters, Broker(min_ops=5)).collect()}
    assert folded == {tuple(r) for r in brokers.broker_profile(nets, cal, Broker(min_ops=5)).collect()}


def test_expected_pressure(two_days, frame):
    nets, cal = two_days
    prof = brokers.broker_profile(nets, cal, Broker(min_ops=5))
    d = days(3)[2]
    today = frame(NETS, (9, d, "flip", 1000.0), (9, d, "hold", 500.0))
    price = frame("instrument_id long, date date, volume double", (9, d, 10000.0))
    r = brokers.expected_pressure(today, prof, price, Broker(min_ops=5)).collect()[0]
    assert (r.expected_lots, r.expected_pct, r.n_flippers) == (800.0, 8.0, 1)
    calm = frame(NETS, (9, d, "hold", 500.0))
    r = brokers.expected_pressure(calm, prof, price, Broker(min_ops=5)).collect()[0]
    assert (r.expected_lots, r.expected_pct, r.n_flippers) == (0.0, 0.0, 0)


def test_flip_pressure_counts_top_buyers_up_to_their_buy(frame):
    d1, d2 = days(2)
    nets = frame(NETS, (1, d1, "big", 100.0), (1, d1, "small", 1.0), (1, d2, "big", -500.0), (1, d2, "small", -300.0))
    price = frame("instrument_id long, date date, volume double", (1, d2, 1000.0))
    cal = trading_calendar(frame("date date", (d1,), (d2,)))
    r = brokers.flip_pressure(nets, price, cal, top=1).collect()[0]
    assert (r.overlap, r.flip_pressure_pct) == (100.0, 10.0)


def test_bars_without_a_buyer_have_no_pressure(frame):
    """The day before had sellers only: 0, not a missing row; neither day may be without broker rows."""
    d = days(4)
    nets = frame(
        NETS, (1, d[0], "a", 10.0), (1, d[1], "a", -4.0), (1, d[1], "b", -1.0), (1, d[2], "a", -2.0), (2, d[0], "a", 3.0), (2, d[2], "a", -3.0), (2, d[3], "a", 8.0),
    )
    price = frame("instrument_id long, date date, volume double", *[(i, x, 100.0) for i in (1, 2) for x in d])
    cal = trading_calendar(price)
    got = {(r.instrument_id, r.date): (r.overlap, r.flip_pressure_pct) for r in brokers.flip_pressure(nets, price, cal).collect()}
    assert got == {(1, d[1]): (4.0, 4.0), (1, d[2]): (0.0, 0.0), (2, d[3]): (0.0, 0.0)}
    p = Broker(min_ops=1, mid=0.0)
    profile = brokers.broker_profile(nets, cal, p)
    expected = {(r.instrument_id, r.date): (r.expected_lots, r.n_flippers, r.expected_pct) for r in brokers.expected_pressure(nets, profile, price, p).collect()}
    assert expected == {
        (1, d[0]): (4.0, 1, 4.0), (1, d[1]): (0.0, 0, 0.0), (1, d[2]): (0.0, 0, 0.0), (2, d[0]): (1.2, 1, 1.2), (2, d[2]): (0.0, 0, 0.0), (2, d[3]): (3.2, 1, 3.2),
    }
    pit = {(r.instrument_id, r.date): r.expected_pct for r in brokers.pit_expected_pressure(nets, price, cal, p).collect()}
    assert pit == {(1, d[2]): 0.0, (2, d[2]): 0.0, (2, d[3]): 3.2}


def test_broker_maps_round_trip(two_days):
    nets, _ = two_days
    back = normalize.broker_rows(normalize.broker_maps(nets))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, nets.collect()))


def test_broker_name_falls_back_to_id(frame):
    t = frame(
        "instrument_id long, date date, broker_id string, broker_name string, buy double, sell double",
        (1, days(1)[0], "9A", None, 3000.0, 500.0), (1, days(1)[0], "1B", "North", 0.0, 1500.0),
    )
    got = {r.broker: r.net for r in normalize.broker_net_from_trades(t).collect()}
    assert got == {"9A": 2.5, "North": -1.5}


def lock_inputs(frame, bars):
    d = days(5)
    price = bars({9999: [100, 100, 100, 100, 110], 1111: [50] * 5})
    flows = [500.0, -300.0, 400.0, -200.0, 600.0]
    rows = [(9999, x, "A", v) for x, v in zip(d, flows)] + [(9999, d[4], "B", -100.0)]
    info = frame("instrument_id long, instrument_name string, industry string, type string", (9999, "X", "i", "twse"), (1111, "Y", "i", "twse"))
    dt = frame("instrument_id long, date date, dt_vol double", (9999, d[4], 250.0))
    return price, info, dt, frame(NETS, *rows), trading_calendar(price)


def test_lock_screen(frame, bars):
    price, info, dt, nets, cal = lock_inputs(frame, bars)
    rows = report.lock_screen(price, info, dt, nets, cal, LockScreen(), Broker(min_ops=1)).collect()
    assert [r.instrument_id for r in rows] == [9999]
    r = rows[0]
    assert r.change_pct == pytest.approx(10.0) and r.main_net_today == 500.0 and r.day_trade_pct == 25.0
    assert r.own_blacklist == "A+600" and r.blacklist_detail == "A+600" and r.blacklist_lots == 600


def test_lock_follow_up(frame, bars):
    d1, d2 = days(2)
    price = bars({9999: [100, (108, 110, 101, 102)], 8888: [50, (49, 55, 48, 54)]})
    picks = frame(
        "date date, rank int, instrument_id long, main_net double, expected_pct double, detail string",
        (d1, 1, 9999, 500.0, 8.0, "A+600、B+50"), (d1, 2, 8888, None, None, None),
    )
    nets = frame(NETS, (9999, d1, "A", 600.0), (9999, d2, "A", -300.0), (9999, d2, "B", 10.0))
    dt = frame("instrument_id long, date date, dt_vol double", (9999, d2, 100.0))
    out = {r.instrument_id: r for r in report.lock_follow_up(picks, price, dt, nets, trading_calendar(price)).collect()}
    assert out[9999].gap_pct == pytest.approx(8.0) and out[9999].intraday_pct == pytest.approx(-5.5555, abs=1e-3)
    assert out[8888].gap_pct == pytest.approx(-2.0) and out[8888].intraday_pct == pytest.approx(10.204, abs=1e-3)
    assert (out[9999].blacklist_bought, out[9999].blacklist_sold) == (650, 300) and out[9999].realised_pct == 30.0


def test_hot_broker_and_instrument_stay_whole(frame):
    """One instrument holds a third of all rows and one broker trades everywhere."""
    d = days(40)
    rows = [(1, x, f"b{k}", float((i * 7 + k * 13) % 41 - 20)) for i, x in enumerate(d) for k in range(20)]
    rows += [(s, x, "b0", float((i + s) % 5 - 2)) for s in range(2, 42) for i, x in enumerate(d)]
    nets = frame(NETS, *rows)
    cal = trading_calendar(frame("date date", *[(x,) for x in d]))
    got = {r.broker: (r.ops, r.flips) for r in brokers.broker_profile(nets, cal, Broker(min_ops=1)).collect()}
    by = {}
    for s, x, b, v in rows:
        by.setdefault((s, x), {})[b] = v
    want = {}
    for (s, x), m in by.items():
        i = d.index(x)
        after = by.get((s, d[i + 1])) if i + 1 < len(d) else None
        if after is None:
            continue
        buys = sorted(((-v, b) for b, v in m.items() if v > 0))[:15]
        for nv, b in buys:
            ops, flips = want.get(b, (0, 0))
            want[b] = (ops + 1, flips + int(after.get(b, 0) < 0))
    assert got == want
    assert brokers.pit_expected_pressure(
        nets, nets.groupBy("instrument_id", "date").agg(F.lit(10.0).alias("volume")), cal, Broker(min_ops=1)
    ).count() == len({(s, x) for s, x, _, _ in rows if x > d[1]})  # the first pair completes on the second date


def test_no_profile_no_pressure(frame):
    d = days(3)
    nets = frame(NETS, *[(1, x, "a", 5.0) for x in d])
    price = nets.groupBy("instrument_id", "date").agg(F.lit(10.0).alias("volume"))
    cal = trading_calendar(frame("date date", *[(x,) for x in d]))
    empty = brokers.broker_profile(nets, cal, Broker(min_ops=99))
    assert brokers.expected_pressure(nets, empty, price).count() == 0
    assert brokers.pit_expected_pressure(nets, price, cal, Broker(min_ops=99)).count() == 0


PRICE = "instrument_id long, date date, open double, high double, low double, close double, volume double"


def pressure_inputs(frame):
    """Two instruments with gaps: dates with a bar alone, with broker rows alone, a missing name, a row without a date."""
    d = days(30)
    price = [(s, x, 1.0, 1.0, 1.0, float((i * 7 + (s or 0) * 5) % 11 + 1), float(i % 4) * 100) for s in (1, 2, None) for i, x in enumerate(d) if (i + (s or 0)) % 9]
    nets = [(s, x, f"b{k}" if k else None, float((i * 5 + k * 11 + s) % 17 - 8)) for s in (1, 2) for i, x in enumerate(d) if (i + s) % 7 for k in range(18)]
    nets += [(1, None, "b1", 9.0), (None, d[3], "b1", 9.0), (2, d[20], "b99", None)]
    return d, frame(PRICE, *price, (1, None, 1.0, 1.0, 1.0, 5.0, 10.0)), frame(NETS, *nets)


def same_rows(a, b):
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(a) == key(b) and a.count()


def exchanges(df):
    """Exchanges of rows by key in the plan; broadcasts are none."""
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("top", (3, 15))
def test_pressure_crosses_one_exchange(frame, top):
    """Same rows as joins of the operators one by one give, from one exchange."""
    _, price, nets = pressure_inputs(frame)
    out = study.pressure_study(price, nets, top=top)
    w = ordered("instrument_id")
    rets = price.select(
        "instrument_id", "date", "volume", pct_simple("close", F.lag("close").over(w)).alias("ret_same"), (F.lead("close").over(w) / F.col("close") * 100 - 100).alias("ret_next")
    ).filter("ret_same is not null AND ret_next is not null AND volume > 0")
    steps, bar = brokers.available_steps(nets), ["instrument_id", "date"]
    overlap = brokers.follow_up(nets, steps, top).groupBy("instrument_id", F.col("sell_date").alias("date")).agg(F.sum("dumped").alias("overlap"))
    want = (
        rets.join(steps.select("instrument_id", F.col("next_date").alias("date")), bar).join(overlap, bar, "left")
        .join(brokers.broker_main_net(nets, top).select(*bar, "main_net"), bar)
        .select(*bar, (F.coalesce("overlap", F.lit(0.0)) / F.col("volume") * 100).alias("pressure"), "main_net", "ret_same", "ret_next")
    )
    digits = lambda df: df.select(*bar, *[(F.round(c, 6) + 0.0).alias(c) for c in ("pressure", "main_net", "ret_same", "ret_next")])
    same_rows(digits(out), digits(want))
    assert exchanges(out) == 1


def test_follow_up_of_dates_crosses_one_exchange(frame):
    d, _, nets = pressure_inputs(frame)
    cal = trading_calendar(frame("date date", *[(x,) for x in d])).localCheckpoint()
    out = brokers.buyer_follow_up(nets, cal, 15)
    same_rows(out, brokers.follow_up(nets, brokers.adjacent_steps(nets, cal), 15))
    assert exchanges(out) - exchanges(cal) <= 3  # rows by instrument; the calendar's join at most two


def test_flows_of_one_panel_are_not_joined(frame):
    """Columns in the price rows give what joins with tables of their own give; a row without a key meets nothing."""
    d = days(2)
    panel = frame(
        PRICE + ", foreign_net double, trust_net double, margin_balance double",
        *[(s, x, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0 + (s or 0), None if s == 2 else 7.0, 8.0) for s in (1, 2, 3, None) for x in (*d, None)],
    )
    info = frame("instrument_id long, type string", (1, "tpex"), (2, "twse"))
    price = panel.drop("foreign_net", "trust_net", "margin_balance")
    out = panel_from_flows(panel, None, None, info)
    want = panel_from_flows(price, panel, panel, info)
    assert out.columns == want.columns
    same_rows(out, want)


def test_small_sides_are_stored_before_they_meet_the_rest(frame, bars, monkeypatch):
    """Levels and picks are made once; their size decides how large tables meet them."""
    seen = []
    for module in (report, technical):
        monkeypatch.setattr(module, "cut_lineage", lambda df, name, stored=module.cut_lineage: seen.append(name) or stored(df, name))
    levels = frame("instrument_id long, close double, atr double", (1, 100.0, 2.0))
    req = frame("account_id long, instrument_id long, account double", (1, 1, 10_000_000.0), (2, 9, 1000.0))
    plan = technical.position_sizing(req, levels)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 2
    test_lock_follow_up(frame, bars)
    assert seen == ["levels", "picks"]
