"""Trade, curve and walk-forward queries with their oracles.

The panel is weekly, so a year has 52 periods here.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RelativeStrength, RevenueMomentum
from ..operators import evaluate as ev
from ..operators import joins, signals
from ..sources.landing import MarketTables
from .registry import query, rounded
from .signals import ACCUM_FEATURES, ACCUM_PARAMS, RS, RS_MEDIAN, RS_RETURNS, VALUE_PARAMS

WEEKS = 52
METRIC_COLS = ("max_drawdown_pct", "sharpe", "volatility_pct")


def config(curve_id: str, hold: int = 8, positions: int = 5, stop: tuple = ("none", 0.0), regime: int = 0, **more) -> dict:
    return {"curve_id": curve_id, "max_positions": positions, "hold": hold, "stop_kind": stop[0], "stop_param": float(stop[1]), "regime": regime, **more}


def cfg_sql(grid: list[dict]) -> str:
    rows = ", ".join(
        f"('{g['curve_id']}', {g['max_positions']}, {g['hold']}, '{g['stop_kind']}', {g['stop_param']}e0, {g['regime']}, '{g.get('signal', '')}')" for g in grid
    )
    return f"SELECT * FROM (VALUES {rows}) v(curve_id, max_positions, hold, stop_kind, stop_param, regime, signal)"


RS_SIGNAL = "SELECT '' AS signal, date, instrument_id, ret - med AS score FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3"
GATE = """SELECT date, coalesce(p >= 45, true) AS regime_ok FROM d_cal LEFT JOIN (
    SELECT date, avg(CASE WHEN close >= m THEN 1e0 ELSE 0e0 END) * 100 AS p FROM (SELECT date, close, avg(close) OVER w AS m, count(*) OVER w AS n FROM d_bars
        WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE n = 20 GROUP BY date) USING (date)"""
E_TABLES = {
    **RS,
    "e_gate": GATE,
    "e_signal": RS_SIGNAL,
    "e_bars": """SELECT *, CASE WHEN count(*) OVER f = 14 THEN avg(tr) OVER f END AS atr FROM
        (SELECT b.*, idx, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
         FROM d_bars b JOIN d_cal USING (date) WHERE close > 0 WINDOW w AS (PARTITION BY instrument_id ORDER BY date))
        WINDOW f AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "e_picks": """SELECT s.*, row_number() OVER (PARTITION BY s.signal, s.date ORDER BY score DESC, instrument_id) AS rk, regime_ok
        FROM e_signal s JOIN e_gate USING (date)""",
    "e_entry": """SELECT g.curve_id, p.instrument_id, p.date AS signal_date, c.idx AS signal_idx, b.date AS entry_date, b.idx AS e_idx, b.open AS entry_price, g.hold,
            CASE WHEN stop_kind = 'pct' THEN b.open * (1 - stop_param) WHEN stop_kind = 'atr' AND atr > 0 THEN b.open - stop_param * atr END AS stop
        FROM e_picks p JOIN e_cfg g ON g.signal = p.signal AND p.rk <= g.max_positions AND (g.regime = 0 OR p.regime_ok)
        JOIN d_cal c ON c.date = p.date JOIN e_bars b ON b.instrument_id = p.instrument_id AND b.date = c.next_date WHERE b.open > 0""",
    "e_timed": """SELECT e.*, t.t_idx FROM e_entry e LEFT JOIN (SELECT curve_id, e.instrument_id, signal_date, min(b.idx) AS t_idx FROM e_entry e
        JOIN e_bars b ON b.instrument_id = e.instrument_id AND b.idx >= e.e_idx + e.hold GROUP BY ALL) t USING (curve_id, instrument_id, signal_date)""",
    "e_exit": """SELECT t.*, s.s_idx, coalesce(s.s_idx, t.t_idx) AS exit_idx FROM e_timed t LEFT JOIN (SELECT curve_id, t.instrument_id, signal_date, min(b.idx) AS s_idx FROM e_timed t
        JOIN e_bars b ON b.instrument_id = t.instrument_id AND b.idx BETWEEN t.e_idx AND coalesce(t.t_idx, t.e_idx + t.hold) AND b.low <= t.stop GROUP BY ALL) s USING (curve_id, instrument_id, signal_date)""",
    "e_trades": """SELECT x.curve_id, x.instrument_id, x.signal_date, x.signal_idx, x.entry_date, x.e_idx, x.entry_price, b.date AS exit_date, x.exit_idx, x.hold, x.t_idx,
            CASE WHEN s_idx IS NOT NULL THEN least(b.open, stop) ELSE b.close END AS exit_price,
            CASE WHEN s_idx IS NOT NULL THEN 'stop' WHEN t_idx IS NOT NULL THEN 'time' END AS exit_reason,
            CASE WHEN s_idx IS NOT NULL THEN least(b.open, stop) ELSE b.close END / x.entry_price * ((1 - 0.004425e0) / (1 + 0.001425e0)) - 1 AS ret
        FROM e_exit x LEFT JOIN e_bars b ON b.instrument_id = x.instrument_id AND b.idx = x.exit_idx""",
    "e_days": """SELECT t.curve_id, t.instrument_id, t.signal_date, t.signal_idx, b.date, b.idx,
            CASE WHEN b.idx = t.exit_idx THEN exit_price * (1 - 0.004425e0) ELSE b.close END
              / coalesce(lag(b.close) OVER (PARTITION BY t.curve_id, t.instrument_id, t.signal_date ORDER BY b.idx), entry_price * (1 + 0.001425e0)) - 1 AS day_ret
        FROM e_trades t JOIN e_bars b ON b.instrument_id = t.instrument_id AND b.idx BETWEEN t.e_idx AND coalesce(t.exit_idx, t.e_idx + t.hold)""",
    "e_curve": """SELECT curve_id, date, idx, coalesce(r, 0) AS day_ret, coalesce(n, 0) AS n_open,
            exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY curve_id ORDER BY idx)) AS equity
        FROM (SELECT curve_id, date, idx FROM e_cfg, d_cal) LEFT JOIN (SELECT curve_id, idx, avg(day_ret) AS r, count(*) AS n FROM e_days GROUP BY ALL) USING (curve_id, idx)""",
}


def metrics_sql(curve: str, keys: str, by: str = "idx", periods: int = WEEKS) -> str:
    return f"""SELECT {keys}, n, (pow(last / first, 1 / (n / {periods}e0)) - 1) * 100 AS cagr_pct, dd * 100 AS max_drawdown_pct,
          CASE WHEN sd > 1e-12 THEN mean / sd * sqrt({periods}) ELSE 0 END AS sharpe, CASE WHEN sd > 1e-12 THEN sd * sqrt({periods}) * 100 ELSE 0 END AS volatility_pct
        FROM (SELECT {keys}, count(*) AS n, arg_min(equity, {by}) AS first, arg_max(equity, {by}) AS last, avg(r) AS mean, stddev_samp(r) AS sd, min(dd) AS dd
          FROM (SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER w - 1 AS dd FROM {curve}
                WINDOW w AS (PARTITION BY {keys} ORDER BY {by})) GROUP BY {keys})"""


# The synthetic prices jump by orders of magnitude: growth and equity are compared as logarithms.
METRICS_OUT = "round(ln(1 + cagr_pct / 100), 6) + 0e0 AS log_growth, " + ", ".join(f"round({c}, 4) + 0e0 AS {c}" for c in METRIC_COLS)
COMPARE_BODY = f"""SELECT curve_id, n, {METRICS_OUT}, coalesce(n_trades, 0) AS n_trades, round(win_rate_pct, 4) AS win_rate_pct, round(mean_ret, 6) AS mean_ret, round(exposure_pct, 4) AS exposure_pct
    FROM e_metrics LEFT JOIN (SELECT curve_id, count(*) AS n_trades, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) * 100 AS win_rate_pct, avg(ret) AS mean_ret
        FROM e_trades WHERE ret IS NOT NULL GROUP BY curve_id) USING (curve_id)
    LEFT JOIN (SELECT curve_id, avg(CASE WHEN n_open > 0 THEN 1e0 ELSE 0e0 END) * 100 AS exposure_pct FROM e_curve GROUP BY curve_id) USING (curve_id)"""
E_METRICS = {"e_metrics": metrics_sql("e_curve", "curve_id")}


def log_growth(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("log_growth", F.log1p(F.col("cagr_pct") / 100)).drop("cagr_pct"), "log_growth")


def rs_signals(m: MarketTables) -> DataFrame:
    return signals.relative_strength_signals(m.bars, RelativeStrength()).select("date", "instrument_id", "score")


def compare(m: MarketTables, sig: DataFrame, grid: list[dict], gate: DataFrame | None) -> DataFrame:
    out = ev.compare(sig, grid, m.bars, m.calendar, gate, WEEKS)
    return rounded(rounded(log_growth(out), *METRIC_COLS, "win_rate_pct", "exposure_pct", digits=4), "mean_ret")


TRADE_GRID = [config("hold", 8), config("pct", 8, stop=("pct", 0.08)), config("atr", 8, stop=("atr", 0.5)), config("gated", 4, 3, regime=1)]


@query(
    "signal_trades",
    """SELECT curve_id, instrument_id, signal_date, entry_date, entry_price, exit_date, round(exit_price, 6) AS exit_price, round(ret, 6) AS ret, exit_reason FROM e_trades""",
    **E_TABLES, e_cfg=cfg_sql(TRADE_GRID),
)
def signal_trades(m: MarketTables) -> DataFrame:
    gated = ev.expand_grid(rs_signals(m), TRADE_GRID, signals.regime_gate(m.bars, m.calendar))
    out = ev.signal_trades(gated, m.bars, m.calendar, (4, 8)).drop("path", "signal_idx", "exit_idx")
    return rounded(out, "exit_price", "ret")


@query(
    "cohort_equity",
    "SELECT curve_id, date, round(day_ret, 6) AS day_ret, n_open, round(ln(equity), 6) + 0e0 AS log_equity FROM e_curve",
    **E_TABLES, e_cfg=cfg_sql(TRADE_GRID),
)
def cohort_equity(m: MarketTables) -> DataFrame:
    _, curves = ev.grid_curves(rs_signals(m), TRADE_GRID, m.bars, m.calendar, signals.regime_gate(m.bars, m.calendar))
    return rounded(curves.select("curve_id", "date", "day_ret", "n_open", F.log("equity").alias("log_equity")), "day_ret", "log_equity")


@query("curve_metrics", COMPARE_BODY, **E_TABLES, **E_METRICS, e_cfg=cfg_sql(TRADE_GRID))
def curve_metrics(m: MarketTables) -> DataFrame:
    return compare(m, rs_signals(m), TRADE_GRID, signals.regime_gate(m.bars, m.calendar))


BUY_HOLD = """SELECT date, avg(close / f) AS equity FROM (SELECT date, close, first_value(close) OVER (PARTITION BY instrument_id ORDER BY date) AS f FROM d_bars) WHERE f > 0 GROUP BY date"""
TIMED = """SELECT date, invested, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS equity FROM
    (SELECT date, coalesce(lag(equity) OVER w IS NOT NULL AND coalesce(lag(regime_ok) OVER w, true), false) AS invested,
        CASE WHEN lag(equity) OVER w IS NOT NULL AND coalesce(lag(regime_ok) OVER w, true) THEN equity / lag(equity) OVER w - 1 ELSE 0 END AS r
     FROM buy_hold JOIN e_gate USING (date) WINDOW w AS (ORDER BY date))"""


@query("buy_hold_curve", "SELECT date, round(equity, 6) AS equity FROM buy_hold", buy_hold=BUY_HOLD)
def buy_hold(m: MarketTables) -> DataFrame:
    return rounded(ev.buy_hold_curve(m.bars), "equity")


def _timed(m: MarketTables) -> DataFrame:
    return ev.timed_curve(ev.buy_hold_curve(m.bars), signals.regime_gate(m.bars, m.calendar))


@query("timed_curve", "SELECT date, invested, round(equity, 6) AS equity FROM timed", buy_hold=BUY_HOLD, timed=TIMED, e_gate=GATE)
def timed(m: MarketTables) -> DataFrame:
    return rounded(_timed(m), "equity")


@query(
    "index_compare",
    f"SELECT curve_id, n, {METRICS_OUT} FROM e_metrics", buy_hold=BUY_HOLD, timed=TIMED, e_gate=GATE,
    i_curves="SELECT 'buy and hold' AS curve_id, date, equity FROM buy_hold UNION ALL SELECT 'timed', date, equity FROM timed",
    e_metrics=metrics_sql("i_curves", "curve_id", "date"),
)
def index_compare(m: MarketTables) -> DataFrame:
    both = ev.buy_hold_curve(m.bars).select(F.lit("buy and hold").alias("curve_id"), "date", "equity").unionByName(
        _timed(m).select(F.lit("timed").alias("curve_id"), "date", "equity")
    )
    return rounded(log_growth(ev.curve_metrics(both, periods=WEEKS)), *METRIC_COLS, digits=4)


FOLDS = """SELECT concat('F', i + 1) AS fold, 0 AS train_lo_idx, n * (i + 1) // 4 AS train_hi_idx, n * (i + 1) // 4 + 1 AS test_lo_idx,
    least(n * (i + 2) // 4, n - 1) AS test_hi_idx FROM (SELECT count(*) AS n FROM d_cal), range(3) r(i) WHERE n * (i + 1) // 4 + 1 < n * (i + 2) // 4"""


@query(
    "make_folds",
    """SELECT fold, a.date AS train_lo, CAST(train_lo_idx AS BIGINT) AS train_lo_idx, b.date AS train_hi, train_hi_idx, c.date AS test_lo, test_lo_idx, d.date AS test_hi, test_hi_idx
       FROM folds JOIN d_cal a ON a.idx = train_lo_idx JOIN d_cal b ON b.idx = train_hi_idx JOIN d_cal c ON c.idx = test_lo_idx JOIN d_cal d ON d.idx = test_hi_idx""",
    folds=FOLDS,
)
def make_folds(m: MarketTables) -> DataFrame:
    return ev.make_folds(m.calendar)


# lookback 10 and 20 x positions 5, 8, 10 x no stop or 8 % x gate off or on
WALK_GRID = [
    config(f"lb{lb} top{top} {stop[0]} gate{gate}", 8, top, stop, gate, signal=f"lb{lb}")
    for lb, top, stop, gate in product((10, 20), (5, 8, 10), (("none", 0.0), ("pct", 0.08)), (0, 1))
]
WALK = {
    **E_TABLES,
    "rs20": RS_RETURNS.replace("lag(close, 10)", "lag(close, 20)"),
    "rs20_median": RS_MEDIAN.replace("rs_returns", "rs20"),
    "e_signal": """SELECT 'lb10' AS signal, date, instrument_id, ret - med AS score FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3
        UNION ALL SELECT 'lb20', date, instrument_id, ret - med FROM rs20 JOIN rs20_median USING (date) WHERE ret BETWEEN 0 AND 0.3""",
    "e_cfg": cfg_sql(WALK_GRID),
    "folds": FOLDS,
    "e_windows": "SELECT fold, 'train' AS role, train_lo_idx AS lo, train_hi_idx AS hi FROM folds UNION ALL SELECT fold, 'test', test_lo_idx, test_hi_idx FROM folds",
    "e_fret": """SELECT d.curve_id, fold, role, d.idx, avg(day_ret) AS r FROM e_days d JOIN e_windows w ON d.signal_idx >= lo AND d.signal_idx < hi AND d.idx <= hi GROUP BY ALL""",
    "e_fcurve": """SELECT curve_id, fold, role, idx, date, coalesce(r, 0) AS day_ret, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY curve_id, fold, role ORDER BY idx)) AS equity
        FROM (SELECT curve_id, fold, role, idx, date FROM e_cfg, e_windows, d_cal WHERE idx BETWEEN lo AND hi) LEFT JOIN e_fret USING (curve_id, fold, role, idx)""",
    "e_fmetrics": metrics_sql("e_fcurve", "curve_id, fold, role"),
    "e_chosen": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(sharpe, 6) DESC, round(ln(1 + cagr_pct / 100), 6) DESC, curve_id) AS k
        FROM e_fmetrics WHERE role = 'train') WHERE k = 1""",
}


def walk_signals(m: MarketTables) -> DataFrame:
    sets = [
        signals.relative_strength_signals(m.bars, RelativeStrength(lookback=lb)).select(F.lit(f"lb{lb}").alias("signal"), "date", "instrument_id", "score")
        for lb in (10, 20)
    ]
    return sets[0].unionByName(sets[1])


def walk(m: MarketTables) -> tuple[DataFrame, DataFrame]:
    gate = signals.regime_gate(m.bars, m.calendar)
    return ev.grid_walk_forward(walk_signals(m), WALK_GRID, m.bars, m.calendar, gate, periods=WEEKS)


@query(
    "grid_walk_forward",
    """SELECT c.fold, c.curve_id, round(c.sharpe, 4) AS train_sharpe, round(ln(1 + c.cagr_pct / 100), 6) AS train_log_growth, round(t.sharpe, 4) AS test_sharpe,
          round(ln(1 + t.cagr_pct / 100), 6) AS test_log_growth, round(t.max_drawdown_pct, 4) AS test_drawdown_pct
       FROM e_chosen c JOIN e_fmetrics t ON t.fold = c.fold AND t.curve_id = c.curve_id AND t.role = 'test'""",
    **WALK,
)
def walk_forward(m: MarketTables) -> DataFrame:
    out = walk(m)[0]
    out = out.withColumns({f"{k}_log_growth": F.log1p(F.col(f"{k}_cagr_pct") / 100) for k in ("train", "test")})
    out = rounded(out.drop("train_cagr_pct", "test_cagr_pct"), "train_log_growth", "test_log_growth")
    return rounded(out, "train_sharpe", "test_sharpe", "test_drawdown_pct", digits=4)


@query(
    "walk_forward_curve",
    """SELECT fold, config, date, round(day_ret, 6) AS day_ret, round(sum(ln(1 + day_ret)) OVER (ORDER BY idx), 6) + 0e0 AS log_equity FROM
       (SELECT f.fold, f.curve_id AS config, idx, date, day_ret FROM e_fcurve f JOIN e_chosen c ON c.fold = f.fold AND c.curve_id = f.curve_id WHERE f.role = 'test')""",
    **WALK,
)
def walk_curve(m: MarketTables) -> DataFrame:
    out = walk(m)[1].select("fold", "config", "date", "day_ret", F.log("equity").alias("log_equity"))
    return rounded(out, "day_ret", "log_equity")


# one knob at a time around the base configuration of the accumulation signal
SWEEP = [
    {"knob": "min_streak", "value": float(v), "min_streak": v, "max_gain": 0.5, "min_buy_ratio": 0.05} for v in (1, 2, 3)
] + [
    {"knob": "max_gain", "value": v, "min_streak": 2, "max_gain": v, "min_buy_ratio": 0.05} for v in (0.2, 0.5, 0.8)
] + [
    {"knob": "min_buy_ratio", "value": v, "min_streak": 2, "max_gain": 0.5, "min_buy_ratio": v} for v in (0.03, 0.05, 0.08)
]
BASE = {k: getattr(ACCUM_PARAMS, k) for k in ("lookback", "allowed_missing", "min_gain", "max_margin_increase", "max_above_ma20")}
SWEEP_GRID = [config(f"{s['knob']}={s['value']:g}", 8, 5, signal=f"{s['knob']}={s['value']:g}") for s in SWEEP] + [
    config(f"hold={h}", h, 5, signal="min_streak=2") for h in (4, 12)
] + [config(f"positions={k}", 8, k, signal="min_streak=2") for k in (3, 8)]


@query(
    "param_sensitivity", COMPARE_BODY,
    **{
        **E_TABLES, **E_METRICS, "ac_features": ACCUM_FEATURES, "e_cfg": cfg_sql(SWEEP_GRID),
        "e_signal": " UNION ALL ".join(
            f"""SELECT '{s['knob']}={s['value']:g}' AS signal, date, instrument_id, buy_days * 3 + buy_ratio * 100 * 2 AS score FROM ac_features
            WHERE n >= 6 AND gain >= -0.5 AND gain < {s['max_gain']} AND least(streak, n) >= {s['min_streak']} AND buy_ratio >= {s['min_buy_ratio']}
              AND (margin_increase IS NULL OR margin_increase <= 1.0) AND (above_ma20 IS NULL OR above_ma20 <= 0.5)""" for s in SWEEP
        ),
    },
)
def param_sensitivity(m: MarketTables) -> DataFrame:
    """Features once; every knob setting is a literal row the features meet."""
    feats = signals.accumulation_features(m.flow_panel, ACCUM_PARAMS.lookback)
    swept = joins.explode_grid(feats, [{**BASE, **s} for s in SWEEP])
    named = F.concat(F.col("cfg.knob"), F.lit("="), F.regexp_replace(F.col("cfg.value").cast("string"), r"\.0$", ""))
    sig = signals.accumulation_gates(swept, cfg="cfg").select(
        named.alias("signal"), "date", "instrument_id", (F.col("buy_days") * 3 + F.col("buy_ratio") * 100 * 2).alias("score")
    )
    return compare(m, sig, SWEEP_GRID, None)


PERIOD_SPLIT = """SELECT concat(curve_id, ' ', p) AS curve_id, idx, equity FROM e_curve, (VALUES ('all', 0e0, 1e0), ('first half', 0e0, 0.5e0), ('second half', 0.5e0, 1e0)) v(p, lo, hi)
    WHERE idx >= floor((SELECT count(*) FROM d_cal) * lo) AND idx <= CASE WHEN hi < 1 THEN floor((SELECT count(*) FROM d_cal) * hi) ELSE 1e9 END"""


@query(
    "period_split", f"SELECT curve_id, n, {METRICS_OUT} FROM e_metrics",
    **{**E_TABLES, "e_cfg": cfg_sql(TRADE_GRID[:2]), "e_split": PERIOD_SPLIT, "e_metrics": metrics_sql("e_split", "curve_id")},
)
def period_split(m: MarketTables) -> DataFrame:
    """Metrics of the same curves over the whole calendar and its halves, split at the median date."""
    _, curves = ev.grid_curves(rs_signals(m), TRADE_GRID[:2], m.bars, m.calendar)
    n = m.calendar.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    mid = F.floor(n / 2)
    parts = F.array_compact(F.array(
        F.lit("all"), F.when(F.col("idx") <= mid, "first half"), F.when(F.col("idx") >= mid, "second half")
    ))
    split = curves.withColumn("part", F.explode(parts)).withColumn("curve_id", F.concat_ws(" ", "curve_id", "part"))
    out = log_growth(ev.curve_metrics(split, periods=WEEKS)).select("curve_id", "n", "log_growth", *METRIC_COLS)
    return rounded(out, *METRIC_COLS, digits=4)


STRATEGIES = [
    config(f"{s} gate{g}", 8, 5, regime=g, signal=s) for s in ("accumulation", "strength", "revenue", "value") for g in (0, 1)
]
REV_SIGNAL = """SELECT 'revenue' AS signal, date, instrument_id, least(yoy, 150) + least(cum_yoy, 100) * 0.5 + least(yoy - cum_yoy, 100) AS score
   FROM d_bars b ASOF JOIN d_revp r ON b.instrument_id = r.instrument_id AND b.date >= r.pub_date WHERE yoy BETWEEN 30 AND 300 AND cum_yoy BETWEEN 2 AND 200 AND yoy - cum_yoy >= 5"""


@query(
    "strategy_compare", COMPARE_BODY,
    **{
        **E_TABLES, **E_METRICS, "ac_features": ACCUM_FEATURES, "e_cfg": cfg_sql(STRATEGIES),
        "e_signal": f"""SELECT 'accumulation' AS signal, date, instrument_id, round(buy_days * 3 + buy_ratio * 100 * 2, 6) AS score FROM ac_features
            WHERE n >= 6 AND gain >= -0.5 AND gain < 0.5 AND least(streak, n) >= 2 AND buy_ratio >= 0.05
              AND (margin_increase IS NULL OR margin_increase <= 1.0) AND (above_ma20 IS NULL OR above_ma20 <= 0.5)
            UNION ALL SELECT 'strength', date, instrument_id, round(ret - med, 6) FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3
            UNION ALL SELECT signal, date, b.instrument_id, round(score, 6) FROM ({REV_SIGNAL.replace('date, instrument_id,', 'date, b.instrument_id,')}) b
            UNION ALL SELECT 'value', date, instrument_id, round("yield" * 3 + 100 / greatest(per, 1) + pbr / per * 100 * 1.5, 6) FROM d_val
              WHERE "yield" >= 4 AND per > 0 AND per <= 26 AND pbr > 0 AND pbr <= 2.5 AND pbr / per * 100 >= 7""",
    },
)
def strategy_compare(m: MarketTables) -> DataFrame:
    sets = {
        "accumulation": signals.accumulation_signals(m.flow_panel, ACCUM_PARAMS),
        "strength": signals.relative_strength_signals(m.bars),
        "revenue": signals.revenue_momentum_signals(m.bars, m.revenue_panel, RevenueMomentum(min_cum=2.0)),
        "value": signals.value_signals(m.valuation, m.bars, VALUE_PARAMS),
    }
    stacked = None
    for name, sig in sets.items():
        part = sig.select(F.lit(name).alias("signal"), "date", "instrument_id", F.round("score", 6).alias("score"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return compare(m, stacked, STRATEGIES, signals.regime_gate(m.bars, m.calendar))


RANKS = [config(r, 8, 5, signal=r) for r in ("rs", "lowvol", "riskadj")]


@query(
    "rank_compare", COMPARE_BODY,
    **{
        **E_TABLES, **E_METRICS, "e_cfg": cfg_sql(RANKS),
        "e_signal": """SELECT 'rs' AS signal, date, instrument_id, round(ret - med, 9) AS score FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3
            UNION ALL SELECT 'lowvol', date, instrument_id, round(-sigma, 9) FROM rs_returns WHERE ret BETWEEN 0 AND 0.3 AND sigma > 0
            UNION ALL SELECT 'riskadj', date, instrument_id, round((ret - med) / sigma, 9) FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3 AND sigma > 0""",
    },
)
def rank_compare(m: MarketTables) -> DataFrame:
    stacked = None
    for rank in ("rs", "lowvol", "riskadj"):
        part = signals.relative_strength_signals(m.bars, rank=rank).select(
            F.lit(rank).alias("signal"), "date", "instrument_id", F.round("score", 9).alias("score")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return compare(m, stacked, RANKS, None)


