from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import evaluate as ev
from tapeframe.operators import joins, study
from tapeframe.sources.calendar import trading_calendar

from .conftest import days


def curve(frame, values, curve_id="c"):
    return frame("curve_id string, date date, equity double", *[(curve_id, d, float(v)) for d, v in zip(days(len(values)), values)])


def test_drawdown(frame):
    r = ev.curve_metrics(curve(frame, [100, 120, 90, 150])).collect()[0]
    assert r.max_drawdown_pct == pytest.approx(-25.0)


def test_flat_curve(frame):
    r = ev.curve_metrics(curve(frame, [100] * 10)).collect()[0]
    assert (r.sharpe, r.volatility_pct, r.cagr_pct) == (0.0, 0.0, 0.0)


def test_metrics_match_pandas(frame):
    import pandas as pd

    s = pd.Series([100, 103, 101, 108, 107, 115.0])
    rets = s.pct_change().dropna()
    r = ev.curve_metrics(curve(frame, s)).collect()[0]
    assert r.sharpe == pytest.approx(rets.mean() / rets.std() * 252**0.5)
    assert r.volatility_pct == pytest.approx(rets.std() * 252**0.5 * 100)
    assert r.cagr_pct == pytest.approx(((s.iloc[-1] / s.iloc[0]) ** (252 / 6) - 1) * 100)


def test_trade_stats(frame):
    t = frame("curve_id string, ret double", ("c", 0.1), ("c", -0.1), ("c", 0.2), ("c", None))
    r = ev.trade_stats(t).collect()[0]
    assert r.n_trades == 3 and r.win_rate_pct == pytest.approx(66.6667, abs=1e-3)


def signal(frame, *rows):
    return frame("curve_id string, date date, instrument_id long, hold int, stop_kind string, stop_param double", *rows)


def test_rising_bars_win(frame, bars):
    b = bars({1: [100 * 1.03**i for i in range(30)]})
    cal = trading_calendar(b)
    s = signal(frame, *[("c", d, 1, 5, "none", 0.0) for d in days(30)[:20]])
    stats = ev.trade_stats(ev.signal_trades(s, b, cal, (5,))).collect()[0]
    assert stats.n_trades == 20 and stats.win_rate_pct == 100.0


STOP_BARS = [100, 100, 100, (95, 100, 85, 95), 100, 100]


def test_stop_fills_at_the_stop(frame, bars):
    b = bars({1: [(100, 100, 100, 100)] * 3 + [(95, 100, 85, 95)] + [100] * 2})
    s = signal(frame, ("pct", days(1)[0], 1, 4, "pct", 0.10), ("none", days(1)[0], 1, 4, "none", 0.0))
    out = {r.curve_id: r for r in ev.signal_trades(s, b, trading_calendar(b), (4,)).collect()}
    assert out["pct"].exit_price == 90.0 and out["pct"].exit_reason == "stop" and -0.12 < out["pct"].ret < -0.09
    assert out["pct"].exit_date == days(4)[3]
    assert out["none"].exit_reason == "time" and out["none"].exit_date == days(6)[5]


def test_gap_below_the_stop_fills_at_the_open(frame, bars):
    b = bars({1: [100, 100, (80, 82, 78, 81), 100, 100, 100]})
    s = signal(frame, ("c", days(1)[0], 1, 3, "pct", 0.10))
    assert ev.signal_trades(s, b, trading_calendar(b), (3,)).collect()[0].exit_price == 80.0


def test_time_exit_waits_for_a_bar(frame, bars):
    b = bars({1: [100, 100, 101, None, None, 105, 106], 2: [50] * 7})
    s = signal(frame, ("c", days(1)[0], 1, 2, "none", 0.0))
    t = ev.signal_trades(s, b, trading_calendar(b), (2,)).collect()[0]
    assert (t.entry_date, t.exit_date, t.exit_price) == (days(2)[1], days(6)[5], 105.0)


def test_no_entry_without_a_next_bar(frame, bars):
    b = bars({1: [100, None, 101, 102], 2: [50] * 4})
    s = signal(frame, ("c", days(1)[0], 1, 1, "none", 0.0), ("c", days(4)[3], 2, 1, "none", 0.0))
    assert ev.signal_trades(s, b, trading_calendar(b), (1,)).count() == 0


def test_cohort_curve_compounds_to_the_trade(frame, bars):
    b = bars({1: [100, 100, 110, 121, 121]})
    cal = trading_calendar(b)
    sig = frame("date date, instrument_id long, score double", (days(1)[0], 1, 1.0))
    grid = [{"curve_id": "c", "max_positions": 1, "hold": 2, "stop_kind": "none", "stop_param": 0.0, "regime": 0}]
    trades, curves = ev.grid_curves(sig, grid, b, cal)
    ret = trades.collect()[0].ret
    equity = {r.date: r.equity for r in curves.collect()}
    assert len(equity) == 5 and equity[days(5)[-1]] == pytest.approx(1 + ret)
    m = ev.compare(sig, grid, b, cal).collect()[0]
    assert (m.n_trades, m.win_rate_pct) == (1, 100.0) and m.exposure_pct == pytest.approx(60.0)


def test_folds(frame):
    cal = trading_calendar(frame("date date", *[(d,) for d in days(1105)]))
    f = {r.fold: r for r in ev.make_folds(cal).collect()}
    assert len(f) == 3 and f["F1"].train_hi_idx == 276 and f["F1"].test_lo_idx == 277
    assert f["F3"].test_hi_idx == 1104 and f["F1"].test_hi_idx < f["F2"].test_lo_idx


def test_walk_forward_covers_the_grid(frame, bars):
    closes = {s: [100 + ((i * (s + 3)) % 17) + i * 0.1 for i in range(60)] for s in range(1, 5)}
    b = bars(closes)
    cal = trading_calendar(b)
    sig = b.select("date", "instrument_id", (F.col("close") % 7).alias("score"))
    grid = [
        {"curve_id": f"h{h}k{k}", "max_positions": k, "hold": h, "stop_kind": "none", "stop_param": 0.0, "regime": 0} for h in (2, 4) for k in (1, 3)
    ]
    chosen, stitched = ev.grid_walk_forward(sig, grid, b, cal)
    assert {r.fold for r in chosen.collect()} == {"F1", "F2", "F3"}
    rows = stitched.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(16, 60)) or len({r.idx for r in rows}) == len(rows)


def test_buy_and_hold(bars):
    got = {r.date: r.equity for r in ev.buy_hold_curve(bars({1: [10, 20], 2: [50, 50]})).collect()}
    assert got[days(2)[1]] == 1.5


def test_timed_curve_follows_yesterdays_gate(frame):
    index = frame("date date, equity double", *[(d, float(v)) for d, v in zip(days(4), (1, 2, 4, 8))])
    gate = frame("date date, regime_ok boolean", *[(d, ok) for d, ok in zip(days(4), (True, False, True, True))])
    got = [round(r.equity, 9) for r in ev.timed_curve(index, gate).orderBy("date").collect()]
    assert got == [1.0, 2.0, 2.0, 4.0]


def test_asof_join_ties_and_strict(frame):
    d = days(4)
    left = frame("instrument_id long, date date", (1, d[1]), (1, d[2]), (2, d[2]))
    right = frame("instrument_id long, pub date, ym string", (1, d[1], "a"), (1, d[1], "b"), (1, d[3], "c"))
    got = {(r.instrument_id, r.date): r.ym for r in joins.asof_join(left, right, "date", "pub", tie_break=["ym"]).collect()}
    assert got == {(1, d[1]): "b", (1, d[2]): "b", (2, d[2]): None}
    strict = {(r.instrument_id, r.date): r.ym for r in joins.asof_join(left, right, "date", "pub", tie_break=["ym"], strict=True).collect()}
    assert strict[(1, d[1])] is None and strict[(1, d[2])] == "b"


def test_lock_study_returns(frame, bars):
    price = bars({1: [100, 110, (121, 130, 110, 115), 115]})
    nets = frame("instrument_id long, date date, broker string, net double", *[(1, d, "a", v) for d, v in zip(days(4), (5.0, 9.0, -4.0, 1.0))])
    from tapeframe.config import LockScreen

    rows = study.lock_study(price, nets, trading_calendar(price), LockScreen(lookback=1)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.gap == pytest.approx(10.0) and r.oc == pytest.approx(-4.9587, abs=1e-3) and r.locked == 1
