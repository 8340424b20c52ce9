from __future__ import annotations

import pytest

from tapeframe.operators import events, flows, report, technical
from tapeframe.sources.calendar import trading_calendar

from .conftest import days

SIGNALS = (
    "instrument_id long, dominance_pct double, margin_volume_pct double, ma_align string, long_term string, bias20_pct double, year_position_pct double, short_margin_pct double"
)


@pytest.mark.parametrize(
    "row, votes, label",
    [
        ((1, 5.0, -3.0, "bull", "above both", 2.0, 80.0, 25.0), 7, "bull"),
        ((1, -5.0, 6.0, "bear", "below both", -2.0, 20.0, 1.0), -6, "bear"),
        ((1, 5.0, 6.0, "bull", "below both", 0.0, 50.0, 1.0), 0, "watch"),
        ((1, None, None, "-", "-", None, None, None), 0, "watch"),
    ],
)
def test_verdict(frame, row, votes, label):
    r = report.verdict_vote(frame(SIGNALS, row)).collect()[0]
    assert (r.verdict_votes, r.verdict) == (votes, label)


def test_missing_signal_is_neutral(frame):
    r = report.verdict_vote(frame("instrument_id long, dominance_pct double", (1, 9.0))).collect()[0]
    assert (r.verdict_votes, r.verdict) == (1, "watch")


def test_atr_levels(bars, frame):
    r = technical.risk_levels(bars({1: [(100, 101, 99, 100)] * 20, 2: [100] * 20, 3: [(100, 101, 99, 100)] * 13})).collect()
    assert len(r) == 1
    assert (r[0].atr, r[0].stop, r[0].stop_pct, r[0].target) == (2.0, 96.0, -4.0, 108.0)


def test_sizing_caps_and_notes(frame):
    levels = frame("instrument_id long, close double, atr double", (1, 100.0, 2.0))
    req = frame("account_id long, instrument_id long, account double", (1, 1, 10_000_000.0), (2, 1, 1000.0))
    out = {r.account_id: r for r in technical.position_sizing(req, levels).collect()}
    assert out[1].lots == 25 and not out[1].capped and out[1].stop == 96.0 and out[1].target == 108.0
    assert out[2].lots is None and out[2].note == "less than one lot"


def test_chip_timeline(frame, bars):
    d = days(2)
    price = bars({1: [105, 109]})
    inst = frame("instrument_id long, date date, foreign_net double, trust_net double, dealer_net double", *[(1, x, 1.0, 2.0, 3.0) for x in d])
    margin = frame("instrument_id long, date date, margin_balance double, short_balance double", (1, d[0], 10000.0, 300.0), (1, d[1], 12122.0, 384.0))
    sbl = frame("instrument_id long, date date, sbl_balance double", (1, d[0], 1000.0), (1, d[1], 1724.0))
    r = technical.chip_timeline(price, inst, margin, sbl).orderBy("date").collect()[1]
    assert round(r.change_pct, 2) == 3.81 and (r.sbl_change, r.margin_change, r.short_change) == (724.0, 2122.0, 84.0)


def test_stale_balances_are_dropped(frame):
    d = days(10)
    cal = trading_calendar(frame("date date", *[(x,) for x in d]))
    sbl = frame("instrument_id long, date date, sbl_balance double", (1, d[8], 5.0), (1, d[9], 7.0), (2, d[6], 9.0), (3, d[3], 1.0))
    out = {r.instrument_id: r for r in flows.sbl_latest(sbl, cal).collect()}
    assert set(out) == {1, 2} and (out[1].sbl_change, out[1].stale_dates) == (2.0, 0)
    assert (out[2].sbl_change, out[2].stale_dates, out[2].sbl_date) == (None, 3, d[6])


def test_day_trade_heat(frame, bars):
    d = days(5)
    dt = frame("instrument_id long, date date, dt_vol double", *[(1, x, v) for x, v in zip(d, (100.0, 100.0, 100.0, 100.0, 150.0))], (2, d[0], 1.0))
    out = flows.day_trade_trend(dt, bars({1: [1] * 5, 2: [1]})).collect()
    assert [(r.instrument_id, r.day_trade_mean_pct, r.day_trade_heat) for r in out] == [(1, 11.0, "heating")]


def test_restrictions(frame):
    rows = [
        (1, "2026-08-10", "2026-08-14", "restricted"), (1, "2026-08-01", "2026-08-05", "restricted"), (2, "2026-08-13", "2026-08-21", "restricted"),
        (3, "2026-08-01", "2026-08-05", "restricted"), (3, None, None, "attention"), (4, None, None, "attention"), (2, None, None, "attention"),
    ]
    n = frame("instrument_id long, s string, e string, kind string", *rows).selectExpr("instrument_id", "cast(s as date) start_date", "cast(e as date) end_date", "kind")
    got = {r.instrument_id: r.restriction for r in events.restriction_labels(n, "2026-08-12").collect()}
    assert got == {1: "restricted until 08-14", 2: "restricted from 08-13 until 08-21", 3: "attention", 4: "attention"}


def test_dividend_labels(frame):
    rows = [
        (1, "2026-08-14", 2.5, None), (1, "2026-09-01", 1.0, None), (2, "2026-08-12", 1.0, 2.0), (3, "2026-12-01", 1.0, None), (4, "2026-08-01", 1.0, None), (5, "2026-08-20", None, 3.0),
    ]
    n = frame("instrument_id long, d string, cash double, share_dividend double", *rows).selectExpr("instrument_id", "cast(d as date) date", "cash", "share_dividend")
    got = {r.instrument_id: r.ex_dividend for r in events.dividend_labels(n, "2026-08-12").collect()}
    assert got == {1: "ex cash 08-14 (2.5)", 2: "ex cash and shares today (1)", 5: "ex shares 08-20 (3)"}


def test_holding_alerts(frame, bars):
    price = bars({1: [95], 2: [130], 3: [110]})
    h = frame(
        "instrument_id long, lots double, cost double, stop double, target double",
        (1, 1.0, 100.0, 96.0, 120.0), (2, 2.0, 100.0, 90.0, 120.0), (3, 1.0, 100.0, 99.0, 120.0), (4, 1.0, 100.0, 99.0, 120.0),
    )
    info = frame("instrument_id long, instrument_name string", (1, "a"))
    status = report.holding_status(h, price, info, trading_calendar(price))
    out = {r.instrument_id: r for r in status.collect()}
    assert [out[i].alert for i in (1, 2, 3, 4)] == ["stop hit", "target hit", "above stop", ""]
    assert out[2].profit == 60000.0 and out[3].to_stop_pct == pytest.approx(10.0) and out[4].profit is None
    total = report.holding_totals(status).collect()[0]
    assert (total.n_holdings, total.total_cost, total.total_profit) == (4, 500000.0, 65000.0)


def test_partial_market_is_flagged(frame):
    d = days(2)
    price = frame("instrument_id long, date date", *[(i, d[0]) for i in range(10)], *[(i, d[1]) for i in range(6)])
    assert [r.incomplete for r in report.data_health(price).orderBy("date").collect()] == [None, True]


def test_attribution_text(frame, bars):
    d = days(2)
    price = bars({1: [100, 105]})
    inst = frame("instrument_id long, date date, foreign_net double, trust_net double, dealer_net double", (1, d[1], -900.0, 1000.0, 0.0))
    margin = frame("instrument_id long, date date, margin_balance double, short_balance double", (1, d[0], 100.0, 10.0), (1, d[1], 90.0, 10.0))
    r = report.move_attribution(price, inst, margin).collect()[0]
    assert r.flow_lead == "trust buys against foreign" and r.flow_tone == "buyers push the price"
    assert r.one_line == "institutions buy, retail stays out: clean rise" and r.margin_note == "retail leaves, cleaner rise"


def test_index_labels(frame):
    d = days(2)
    rows = [(s, x, v) for s, vs in {"a": (100.0, 96.0), "b": (100.0, 101.5), "c": (100.0, 100.2)}.items() for x, v in zip(d, vs)]
    got = {r.symbol: r.label for r in technical.index_change(frame("symbol string, date date, close double", *rows)).collect()}
    assert got == {"a": "plunge", "b": "firm", "c": "flat"}
