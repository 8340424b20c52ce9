from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeframe.config import Accumulation, QuietAccumulation, RevenueMomentum, Value
from tapeframe.functions.columns import detail_map, local_date, local_period, round_trip_return
from tapeframe.functions.quantiles import binned_quantiles, bracketed_quantiles, exact_median, exact_quantiles, quantile_bins, rank_bins
from tapeframe.functions.windows import buy_streak, latest_streaks, ordered
from tapeframe.operators import screens, signals
from tapeframe.sources.calendar import trading_calendar

from .conftest import days


def nets(frame, values):
    rows = [(1, d, None if v is None else float(v)) for d, v in zip(days(len(values)), values)]
    return frame("instrument_id long, date date, net double", *rows)


@pytest.mark.parametrize(
    "values, expected",
    [([1, 2, 3], 3), ([-1, -2], -2), ([5, -1, 2, 3], 2), ([3, 0], 0), ([1, None], 0), ([2, None, 1, 1], 2), ([0, -1], -1), ([1, -1], -1)],
)
def test_latest_streak(frame, values, expected):
    out = latest_streaks(nets(frame, values), "instrument_id", {"net": "s"}).collect()
    assert out[0].s == expected


def test_buy_streak_series(frame):
    df = nets(frame, [1, 2, -1, 3, 0, 4, 5, None, 6])
    out = df.select("date", buy_streak("net", ordered("instrument_id")).alias("s")).orderBy("date")
    assert [r.s for r in out.collect()] == [1, 2, 0, 1, 0, 1, 2, 0, 1]


def test_round_trip_costs(frame):
    df = frame("e double, x double", (100.0, 110.0), (0.0, 110.0), (100.0, None))
    got = [r[0] for r in df.select(round_trip_return("e", "x")).collect()]
    assert got[0] == pytest.approx(1.1 * (1 - 0.004425) / (1 + 0.001425) - 1)
    assert got[1:] == [0.0, 0.0]


def test_local_dates(frame):
    df = frame("t string", ("115/08/10",), ("1150810",), ("115-08-10",), ("15/8/1",), ("",), ("1151340",))
    got = [str(r[0]) for r in df.select(local_date("t")).collect()]
    assert got == ["2026-08-10"] * 3 + ["None"] * 3


def test_local_period(frame):
    df = frame("t string", ("115/08/10～115/08/14",), ("1150813~1150821",), ("115/08/10",))
    start, end = local_period("t")
    got = [(str(r[0]), str(r[1])) for r in df.select(start, end).collect()]
    assert got == [("2026-08-10", "2026-08-14"), ("2026-08-13", "2026-08-21"), ("2026-08-10", "2026-08-10")]


def test_detail_map(frame):
    df = frame("t string", ("North+1234、South-East+890、odd",), ("",))
    got = [r[0] for r in df.select(detail_map("t")).collect()]
    assert got == [{"North": 1234, "South-East": 890}, {}]


WINDOW = dict(close=[100, 101, 102, 103, 104, 105, 105, 106, 106, 107], net=[10, -5, 5, 5, 5, 100, 100, 100, 100, 100])


def accumulation_panel(frame, close=None, net=None, margin=None, volume=1000.0):
    close, net = close or WINDOW["close"], net or WINDOW["net"]
    margin = margin or [1000.0] * len(close)
    rows = [(1, d, float(c), volume, float(n), float(m)) for d, c, n, m in zip(days(len(close)), close, net, margin)]
    return frame("instrument_id long, date date, close double, volume double, inst_net double, margin_balance double", *rows)


@pytest.mark.parametrize(
    "change, passes",
    [
        ({}, True),
        ({"close": [100] * 9 + [113]}, False),
        ({"close": [100] * 9 + [91]}, False),
        ({"net": WINDOW["net"][:-1] + [-1]}, False),
        ({"net": [0] * 6 + [10] * 4}, False),
        ({"margin": [1000.0] * 9 + [1200.0]}, False),
    ],
)
def test_accumulation_gates(frame, change, passes):
    panel = accumulation_panel(frame, **change)
    last = days(10)[-1]
    got = signals.accumulation_signals(panel, Accumulation()).filter(F.col("date") == F.lit(last)).count()
    assert got == int(passes)


def test_quiet_accumulation_waits_for_a_year(frame):
    n = 300
    rows = [
        (1, d, 100 + (i % 3) * 0.2, 500.0 if i >= n - 10 else 1000.0, 30.0) for i, d in enumerate(days(n))
    ]
    schema = "instrument_id long, date date, close double, volume double, inst_net double"
    panel = frame(schema, *rows)
    got = [r.date for r in signals.quiet_accumulation_signals(panel, QuietAccumulation()).select("date").collect()]
    assert got and min(got) >= days(n)[240]
    silent = panel.withColumn("inst_net", F.lit(0.0))
    assert signals.quiet_accumulation_signals(silent).count() == 0


def revenue(frame, *rows):
    return frame("instrument_id long, pub_date date, ym string, yoy double, cum_yoy double", *rows)


def test_revenue_only_after_publication(frame, bars):
    d = days(8)
    b = bars({1: [100] * 8})
    rev = revenue(frame, (1, d[3], "2023-12", 50.0, 30.0))
    got = sorted(r.date for r in signals.revenue_momentum_signals(b, rev).collect())
    assert got == d[3:]


def test_latest_publication_wins(frame, bars):
    d = days(8)
    rev = revenue(frame, (1, d[0], "2023-11", 50.0, 30.0), (1, d[4], "2023-12", 5.0, 3.0))
    got = {r.date for r in signals.revenue_momentum_signals(bars({1: [100] * 8}), rev, RevenueMomentum()).collect()}
    assert d[2] in got and d[5] not in got


def test_value_signals(frame, bars):
    d = days(1)[0]
    val = frame(
        "date date, instrument_id long, yield double, per double, pbr double",
        (d, 1, 5.0, 10.0, 1.5), (d, 2, 2.0, 10.0, 1.5), (d, 3, 5.0, 25.0, 1.5), (d, 4, 5.0, 30.0, 1.0),
    )
    out = signals.value_signals(val, bars({i: [10] for i in (1, 2, 3, 4)}), Value()).collect()
    assert [r.instrument_id for r in out] == [1]


def test_relative_strength_ranks(bars):
    closes = {k: [100 * (1 + k * 0.002) ** i for i in range(40)] for k in (1, 2, 3)}
    b = bars(closes)
    rs = signals.relative_strength_signals(b)
    last = {r.instrument_id: r.score for r in rs.filter(F.col("date") == F.lit(days(40)[-1])).collect()}
    assert last[3] > last[2] == pytest.approx(0, abs=1e-12) and last[1] < 0


def test_no_look_ahead(bars):
    import random

    rng = random.Random(7)
    closes = {}
    for sid in range(1, 8):
        path = [100.0]
        for _ in range(59):
            path.append(path[-1] * (1 + rng.uniform(-0.04, 0.045)))
        closes[sid] = path
    full = bars(closes)
    cut = days(60)[40]
    short = full.filter(F.col("date") <= F.lit(cut))
    for rank in ("rs", "riskadj"):
        a = {tuple(r) for r in signals.relative_strength_signals(full, rank=rank).filter(F.col("date") <= F.lit(cut)).collect()}
        b = {tuple(r) for r in signals.relative_strength_signals(short, rank=rank).collect()}
        assert a == b and a


def test_soft_screen_is_a_superset(frame):
    d = days(10)
    price = frame("instrument_id long, date date, close double, volume double", *[(s, x, 100.0, 1000.0) for s in (1, 3) for x in d])
    flows = {1: [0] * 6 + [200] * 4, 3: [0] * 6 + [-50, 200, 200, 200]}
    inst = frame(
        "instrument_id long, date date, foreign_net double, trust_net double, dealer_net double",
        *[(s, x, 0.0, float(v), 0.0) for s, vs in flows.items() for x, v in zip(d, vs)],
    )
    margin = frame("instrument_id long, date date, margin_balance double", *[(s, x, 100.0) for s in (1, 3) for x in d])
    info = frame("instrument_id long, instrument_name string, industry string, type string", (1, "A", "i", "twse"), (3, "B", "i", "twse"))
    strict = {r.instrument_id for r in screens.accumulation_screen(price, inst, margin, info).collect()}
    soft = {r.instrument_id for r in screens.accumulation_screen(price, inst, margin, info, min_streak=3).collect()}
    assert strict == {1} and soft == {1, 3}


def test_regime_gate_open_without_history(bars):
    b = bars({1: [100 + i for i in range(25)], 2: [100 - i for i in range(25)]})
    out = {r.date: r for r in signals.regime_gate(b, trading_calendar(b), 60.0).collect()}
    d = days(25)
    assert out[d[5]].regime_ok and out[d[5]].pct_above is None
    assert out[d[24]].pct_above == 50.0 and not out[d[24]].regime_ok


def test_exact_quantiles_match_numpy(frame):
    import numpy as np

    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 500), np.zeros(400), rng.lognormal(3, 2, 101)])
    df = frame("g int, v double", *[(i % 3, float(x)) for i, x in enumerate(v)])
    probs = [0, 0.1, 0.5, 0.8, 1]
    got = exact_quantiles(df, "v", probs).collect()[0]
    assert got.n == len(v) and got.q == pytest.approx(list(np.quantile(v, probs)), abs=1e-12)
    med = {r.g: r.median for r in exact_median(df, "v", ["g"]).collect()}
    for g in range(3):
        assert med[g] == pytest.approx(np.median(v[g::3]), abs=1e-12)


def test_grouped_quantiles_of_any_shape(frame, spark):
    """Sizes from one to thousands, ties, heavy tails and one group that holds most rows; sketches only bracket, ranks are exact."""
    rng = np.random.default_rng(12)
    groups = {g: rng.normal(size=n) * 10.0**rng.integers(-3, 9) for g, n in enumerate((1, 2, 3, 4, 7, 10, 99, 1000, 20000))}
    groups |= {50: np.full(300, 2.5), 51: rng.integers(0, 3, 5000).astype(float), 52: np.exp(rng.normal(size=3000) * 8), 53: np.concatenate([np.zeros(2500), rng.normal(size=2500)])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(0, None), (99, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    for quantiles in (bracketed_quantiles, binned_quantiles):
        got = {r.g: (r.n, r.q) for r in quantiles(df, "v", probs, ["g"]).collect()}
        assert set(got) == set(groups)
        for g, vs in groups.items():
            assert got[g][0] == len(vs) and got[g][1] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12, abs=1e-12)


def test_quantile_bins_match_pandas(frame):
    import pandas as pd

    v = [float((i * 37) % 101) ** 1.5 - 50 for i in range(200)]
    df = frame("i int, v double", *enumerate(v))
    want = pd.qcut(pd.Series(v), 5, labels=False) + 1
    got = {r.i: r.bin for r in quantile_bins(df, "v", 5).collect()}
    assert [got[i] for i in range(200)] == list(want)


def test_rank_bins_split_ties(frame):
    import pandas as pd

    df = frame("i int, v double", *[(i, 0.0 if i < 90 else float(i)) for i in range(100)])
    want = pd.qcut(pd.Series(range(1, 101)), 5, labels=False) + 1
    got = {r.i: r.bin for r in rank_bins(df, 5, "v", "i").collect()}
    assert [got[i] for i in range(100)] == list(want)


def test_streaks_deepen_only_where_a_run_goes_on(spark, frame, monkeypatch):
    """Four dates are read when all runs end within them; else only keys with an open run go on, and the dates are literals of the scan."""
    from tapeframe.functions import windows
    from tapeframe.session import shared_folder
    from tapeframe.sources.calendar import trading_calendar

    d = days(40)
    series = {1: [1, -1, 1], 2: [-2], 3: [3, -1] + [1] * 30, 4: [1] * 40, 5: [0], 6: [None, 1, 1]}
    rows = [(k, x, None if v is None else float(v)) for k, vs in series.items() for x, v in zip(d[-len(vs):], vs)] + [(7, d[2], 1.0), (7, d[1], 1.0), (7, d[0], -1.0)]
    path = shared_folder(spark, "nets")
    frame("instrument_id long, date date, net double", *rows).repartitionByRange(4, "date").write.parquet(path)
    table, cal = spark.read.parquet(path), trading_calendar(frame("date date", *[(x,) for x in d]))
    keys = table.select("instrument_id").distinct().unionByName(frame("instrument_id long", (99,)))
    read, plain = [], windows.streak_runs

    def watched(df, key, columns, by="date"):
        read.append((df.agg(F.min("date")).first()[0], {r[0] for r in df.select(key).distinct().collect()}, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, key, columns, by)

    monkeypatch.setattr(windows, "streak_runs", watched)
    ended = windows.deepening_streaks(table.filter("instrument_id in (1, 3, 6)"), cal, keys.filter("instrument_id in (1, 6)"), {"net": "s"})
    assert {r.instrument_id: r.s for r in ended.collect()} == {1: 1, 6: 2}
    assert len(read) == 1 and f"GreaterThanOrEqual(date,{d[-4]})" in read[0][2]
    read.clear()
    got = {r.instrument_id: r.s for r in windows.deepening_streaks(table, cal, keys, {"net": "s"}).collect()}
    assert got == {r.instrument_id: r.s for r in plain(table, "instrument_id", {"net": "s"}).collect()} == {1: 1, 2: -1, 3: 30, 4: 40, 5: 0, 6: 2, 7: 2}
    assert [k for _, k, _ in read[:3]] == [{1, 2, 3, 4, 5, 6}, {2, 3, 4}, {2, 3, 4, 7}]
    enough = {r.instrument_id: r.s for r in windows.deepening_streaks(table, cal, keys, {"net": "s"}, enough=3).collect()}
    assert enough[3] >= 3 and enough[4] >= 3 and enough[2] == -1 and enough[7] == 2
