"""Event-study queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LockScreen
from ..operators import brokers, study
from ..sources.landing import MarketTables
from .brokers import FOLLOW, PIT, TOP, P
from .registry import query, rounded
from .report import LOCK

STUDY_P = LockScreen(lookback=8)
S_TABLES = {
    **LOCK, **PIT,
    "s_steps": "SELECT instrument_id, date, lead(date) OVER (PARTITION BY instrument_id ORDER BY date) AS nd FROM (SELECT DISTINCT instrument_id, date FROM d_broker)",
    "s_flips": """SELECT b.instrument_id, b.broker, x.idx AS bi, y.idx AS si FROM b_top b JOIN s_steps s ON s.instrument_id = b.instrument_id AND s.date = b.date
        JOIN d_broker a ON a.instrument_id = b.instrument_id AND a.broker = b.broker AND a.date = s.nd AND a.net < 0 JOIN d_cal x ON x.date = b.date JOIN d_cal y ON y.date = s.nd""",
    "s_hits": """SELECT h.instrument_id, h.date, max(h.hits) AS hits, max(CASE WHEN h.rk <= 5 THEN 1 ELSE 0 END) AS hit_top5 FROM
        (SELECT t.instrument_id, t.date, t.broker, t.rk, count(*) AS hits FROM b_top t JOIN d_cal c ON c.date = t.date
         JOIN s_flips f ON f.instrument_id = t.instrument_id AND f.broker = t.broker AND f.bi >= c.idx - 8 AND f.si <= c.idx GROUP BY ALL) h GROUP BY h.instrument_id, h.date""",
    "s_lock": """SELECT l.date, l.instrument_id, l.change_pct, m.main_net, CAST(m.main_net > 0 AS INTEGER) AS locked, CASE WHEN m.main_net > 0 THEN coalesce(h.hits, 0) ELSE 0 END AS hits,
            CASE WHEN m.main_net > 0 THEN coalesce(h.hit_top5, 0) ELSE 0 END AS hit_top5, (n.open - l.close) / l.close * 100 AS gap, (n.close - n.open) / n.open * 100 AS oc,
            (n.close - l.close) / l.close * 100 AS cc
        FROM l_cand l JOIN d_bars n ON n.instrument_id = l.instrument_id AND n.date = l.next_date JOIN b_main m ON m.instrument_id = l.instrument_id AND m.date = l.date
        LEFT JOIN s_hits h ON h.instrument_id = l.instrument_id AND h.date = l.date WHERE l.idx >= 8 AND n.open > 0 AND n.close > 0""",
    "s_over": """SELECT b.instrument_id, s.nd AS date, sum(CASE WHEN a.net < 0 THEN least(b.net, -a.net) ELSE 0e0 END) AS overlap FROM b_top b JOIN s_steps s ON s.instrument_id = b.instrument_id AND s.date = b.date
        LEFT JOIN d_broker a ON a.instrument_id = b.instrument_id AND a.broker = b.broker AND a.date = s.nd GROUP BY ALL""",
    "s_press": """SELECT p.instrument_id, p.date, coalesce(overlap, 0) / volume * 100 AS pressure, main_net, ret_same, ret_next FROM
        (SELECT instrument_id, date, volume, (close - lag(close) OVER w) / lag(close) OVER w * 100 AS ret_same, (lead(close) OVER w - close) / close * 100 AS ret_next
         FROM d_bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date)) p JOIN b_main m USING (instrument_id, date) LEFT JOIN s_over o USING (instrument_id, date)
        WHERE ret_same IS NOT NULL AND ret_next IS NOT NULL AND volume > 0""",
    # equal pressures make value edges fall together, so ranks are binned
    "s_bin": """SELECT *, CAST(greatest(1, ceil((k - 1) * 5 / (n - 1))) AS INTEGER) AS bin FROM
        (SELECT *, row_number() OVER (ORDER BY pressure, instrument_id, date) AS k, count(*) OVER () AS n FROM s_press)""",
}


def lock_rows(m: MarketTables) -> DataFrame:
    return study.lock_study(m.bars, m.broker_net, m.calendar, STUDY_P, TOP)


def press(m: MarketTables) -> DataFrame:
    return study.pressure_study(m.bars, m.broker_net, top=TOP)


@query(
    "lock_study",
    """SELECT date, instrument_id, round(change_pct, 6) AS change_pct, main_net, locked, hits, hit_top5, round(gap, 6) + 0e0 AS gap, round(oc, 6) + 0e0 AS oc, round(cc, 6) + 0e0 AS cc FROM s_lock""",
    **S_TABLES,
)
def lock_study(m: MarketTables) -> DataFrame:
    return rounded(lock_rows(m), "change_pct", "gap", "oc", "cc")


@query(
    "pressure_study",
    "SELECT instrument_id, date, round(pressure, 6) AS pressure, main_net, round(ret_same, 6) + 0e0 AS ret_same, round(ret_next, 6) + 0e0 AS ret_next FROM s_press", **S_TABLES,
)
def pressure_study(m: MarketTables) -> DataFrame:
    return rounded(press(m), "pressure", "ret_same", "ret_next")


@query(
    "factor_buckets",
    """SELECT bin, count(*) AS n, round(avg(pressure), 6) AS factor_mean, round(avg(ret_next), 6) AS outcome_mean, round(avg(CASE WHEN ret_next < 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS below_zero_pct,
          round(median(pressure), 6) AS factor_median FROM s_bin GROUP BY bin""", **S_TABLES,
)
def factor_buckets(m: MarketTables) -> DataFrame:
    out = study.factor_buckets(press(m), "pressure", "ret_next", 5)
    return rounded(out, "factor_mean", "outcome_mean", "below_zero_pct", "factor_median")


@query(
    "factor_correlations",
    """SELECT (SELECT count(*) FROM s_press) AS n, factor, outcome, round(c, 6) AS corr FROM (
         SELECT 'pressure' AS factor, 'ret_next' AS outcome, corr(pressure, ret_next) AS c FROM s_press UNION ALL SELECT 'pressure', 'ret_same', corr(pressure, ret_same) FROM s_press
         UNION ALL SELECT 'main_net', 'ret_next', corr(main_net, ret_next) FROM s_press UNION ALL SELECT 'main_net', 'ret_same', corr(main_net, ret_same) FROM s_press)""", **S_TABLES,
)
def factor_correlations(m: MarketTables) -> DataFrame:
    return rounded(study.factor_correlations(press(m), ("pressure", "main_net"), ("ret_next", "ret_same")), "corr")


@query(
    "threshold_buckets",
    """SELECT CAST(t AS DOUBLE) AS threshold, count(*) AS n, round(avg(ret_next), 6) AS outcome_mean, round(avg(CASE WHEN ret_next < 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS below_zero_pct
       FROM s_press JOIN (VALUES (10), (15), (20), (30)) v(t) ON pressure >= t GROUP BY t HAVING count(*) >= 20""", **S_TABLES,
)
def threshold_buckets(m: MarketTables) -> DataFrame:
    return rounded(study.threshold_buckets(press(m), "pressure", "ret_next", (10, 15, 20, 30)), "outcome_mean", "below_zero_pct")


@query(
    "mask_groups",
    """SELECT mask, count(*) AS n, round(avg(gap), 6) AS gap_mean, round(avg(CASE WHEN gap < 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS gap_below_zero_pct, round(avg(oc), 6) AS oc_mean,
          round(avg(CASE WHEN oc < 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS oc_below_zero_pct, round(avg(cc), 6) AS cc_mean, round(avg(CASE WHEN cc < 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS cc_below_zero_pct
       FROM (SELECT 'all' AS mask, * FROM s_lock UNION ALL SELECT 'locked', * FROM s_lock WHERE locked = 1 UNION ALL SELECT 'sold', * FROM s_lock WHERE locked = 0
             UNION ALL SELECT 'hits>=1', * FROM s_lock WHERE hits >= 1 UNION ALL SELECT 'hits>=2', * FROM s_lock WHERE hits >= 2) GROUP BY mask HAVING count(*) >= 8""", **S_TABLES,
)
def mask_groups(m: MarketTables) -> DataFrame:
    masks = {"all": F.lit(True), "locked": F.col("locked") == 1, "sold": F.col("locked") == 0, "hits>=1": F.col("hits") >= 1, "hits>=2": F.col("hits") >= 2}
    out = study.mask_groups(lock_rows(m), masks, ("gap", "oc", "cc"))
    return rounded(out, *[c for c in out.columns if c not in ("mask", "n")])


@query(
    "upper_tail_weak",
    """SELECT count(*) AS n, round(avg(ret_next), 6) AS outcome_mean FROM s_press WHERE pressure >= (SELECT quantile_cont(pressure, 0.8) FROM s_press) AND ret_same < 0""", **S_TABLES,
)
def upper_tail(m: MarketTables) -> DataFrame:
    tail = study.upper_tail(press(m), "pressure", 0.8).filter("ret_same < 0")
    return rounded(tail.agg(F.count(F.lit(1)).alias("n"), F.avg("ret_next").alias("outcome_mean")), "outcome_mean")


@query(
    "pit_pressure_study",
    """SELECT date, instrument_id, round(expected_pct, 6) AS expected_pct, n_flippers, round(gap, 6) + 0e0 AS gap, round(oc, 6) + 0e0 AS oc, round(cc, 6) + 0e0 AS cc
       FROM s_lock JOIN b_pitx USING (instrument_id, date) WHERE expected_pct IS NOT NULL""", **{**S_TABLES, **FOLLOW, **PIT},
)
def pit_pressure(m: MarketTables) -> DataFrame:
    out = study.pit_pressure_study(lock_rows(m), brokers.pit_expected_pressure(m.broker_net, m.bars, m.calendar, P, m.broker_history(P)))
    return rounded(out.select("date", "instrument_id", "expected_pct", "n_flippers", "gap", "oc", "cc"), "expected_pct", "gap", "oc", "cc")


@query(
    "liquid_universe",
    """SELECT instrument_id, close, round(av, 6) AS avg_volume FROM (SELECT instrument_id, arg_max(close, date) AS close, avg(volume) AS av FROM d_bars GROUP BY instrument_id)
       WHERE close >= 10 ORDER BY av DESC, instrument_id LIMIT 15""",
)
def liquid_universe(m: MarketTables) -> DataFrame:
    return rounded(study.liquid_universe(m.bars, 15), "avg_volume")


@query(
    "volatile_universe",
    """SELECT instrument_id, close, round(av, 6) AS avg_volume, round(sd, 6) AS sd, round(sd * ln(amt), 6) AS score FROM (SELECT instrument_id, count(*) AS n, arg_max(close, date) AS close, avg(volume) AS av,
         stddev_samp(r) AS sd, avg(close * volume) AS amt FROM (SELECT *, (close - lag(close) OVER (PARTITION BY instrument_id ORDER BY date)) / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) * 100 AS r
           FROM d_bars WHERE date IN (SELECT date FROM d_cal WHERE age <= 46)) GROUP BY instrument_id)
       WHERE n >= 46 * 0.7 AND av > 20 AND close > 10 AND close < 60000 AND sd IS NOT NULL ORDER BY round(sd * ln(amt), 6) DESC, instrument_id LIMIT 12""",
)
def volatile_universe(m: MarketTables) -> DataFrame:
    out = study.volatile_universe(m.bars, m.calendar, 46, 12, min_volume=20, max_close=60000)
    return rounded(out, "avg_volume", "sd", "score")
