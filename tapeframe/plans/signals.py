"""Point-in-time signal queries.

The synthetic panel is weekly and thin, so gates are widened by parameters; the
oracle uses the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Accumulation, QuietAccumulation, RelativeStrength, RevenueMomentum, Value
from ..operators import joins, signals
from ..sources.landing import MarketTables
from .registry import query, rounded

RS_RETURNS = """
    SELECT *, CASE WHEN i >= 20 THEN stddev_pop(r1) OVER (PARTITION BY instrument_id ORDER BY date
                     ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sigma
    FROM (SELECT instrument_id, date, row_number() OVER w - 1 AS i,
             CASE WHEN lag(close, 10) OVER w > 0 THEN close / lag(close, 10) OVER w - 1 END AS ret,
             coalesce(CASE WHEN lag(close) OVER w > 0 THEN close / lag(close) OVER w - 1 END, 0e0) AS r1
          FROM d_bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date))"""
RS_MEDIAN = "SELECT date, median(ret) AS med FROM rs_returns WHERE ret IS NOT NULL GROUP BY date"
RS = {"rs_returns": RS_RETURNS, "rs_median": RS_MEDIAN}


@query(
    "relative_strength_signals",
    """SELECT date, instrument_id, round(ret, 6) AS ret, round(med, 6) AS market_ret, round(ret - med, 6) AS score
       FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3""",
    **RS,
)
def relative_strength(m: MarketTables) -> DataFrame:
    out = signals.relative_strength_signals(m.bars, RelativeStrength())
    return rounded(out, "ret", "market_ret", "score")


@query(
    "relative_strength_lowvol",
    """SELECT date, instrument_id, round(ret, 6) AS ret, round(med, 6) AS market_ret, round(-sigma, 6) AS score
       FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3 AND sigma > 0""",
    **RS,
)
def relative_strength_lowvol(m: MarketTables) -> DataFrame:
    return rounded(signals.relative_strength_signals(m.bars, rank="lowvol"), "ret", "market_ret", "score")


@query(
    "relative_strength_riskadj",
    """SELECT date, instrument_id, round(ret, 6) AS ret, round(med, 6) AS market_ret, round((ret - med) / sigma, 6) AS score
       FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3 AND sigma > 0""",
    **RS,
)
def relative_strength_riskadj(m: MarketTables) -> DataFrame:
    return rounded(signals.relative_strength_signals(m.bars, rank="riskadj"), "ret", "market_ret", "score")


ACCUM_PARAMS = Accumulation(
    allowed_missing=4, min_streak=2, min_gain=-0.5, max_gain=0.5, max_margin_increase=1.0, max_above_ma20=0.5
)
ACCUM_FEATURES = """
    SELECT instrument_id, date, close, count(*) OVER t AS n,
           CASE WHEN first_value(close) OVER t > 0 THEN (close - first_value(close) OVER t) / first_value(close) OVER t END AS gain,
           row_number() OVER (PARTITION BY instrument_id, island ORDER BY date) - (CASE WHEN island > 0 THEN 1 ELSE 0 END) AS streak,
           CASE WHEN sum(volume) OVER t > 0 THEN sum(inst_net) OVER t / sum(volume) OVER t ELSE 0e0 END AS buy_ratio,
           CASE WHEN count(margin_balance) OVER t >= 2 AND first_value(margin_balance) OVER t <> 0
                THEN (margin_balance - first_value(margin_balance) OVER t) / abs(first_value(margin_balance) OVER t) END AS margin_increase,
           CASE WHEN count(*) OVER m = 20 THEN (close - avg(close) OVER m) / avg(close) OVER m END AS above_ma20,
           sum(CASE WHEN inst_net > 0 THEN 1 ELSE 0 END) OVER t AS buy_days
    FROM (SELECT *, sum(CASE WHEN inst_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY date) AS island FROM d_flow)
    WINDOW t AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
           m AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query(
    "accumulation_signals",
    """SELECT date, instrument_id, round(gain, 6) AS gain, CAST(streak AS BIGINT) AS streak, round(buy_ratio, 6) AS buy_ratio,
              round(buy_days * 3 + buy_ratio * 100 * 2, 6) AS score
       FROM ac_features
       WHERE n >= 6 AND gain >= -0.5 AND gain < 0.5 AND least(streak, n) >= 2 AND buy_ratio >= 0.05
         AND (margin_increase IS NULL OR margin_increase <= 1.0) AND (above_ma20 IS NULL OR above_ma20 <= 0.5)""",
    ac_features=ACCUM_FEATURES,
)
def accumulation(m: MarketTables) -> DataFrame:
    out = signals.accumulation_signals(m.flow_panel, ACCUM_PARAMS)
    return rounded(out.withColumn("streak", out.streak.cast("long")), "gain", "buy_ratio", "score")


QUIET_PARAMS = QuietAccumulation(min_days=8, min_return=-0.6, max_return=0.6, ma_dev=0.4, volume_squeeze=1.3, max_position=90)


@query(
    "quiet_accumulation_signals",
    """SELECT date, instrument_id, round(ret, 6) AS ret, round(squeeze, 6) AS squeeze, round(position, 6) AS position,
              round(buy_ratio, 6) AS score
       FROM qa WHERE i >= 240 AND buy_ratio >= 0.02 AND buy_days >= 8 AND ret BETWEEN -0.6 AND 0.6
         AND abs(close / ma20 - 1) <= 0.4 AND squeeze <= 1.3 AND (position IS NULL OR position <= 90)""",
    qa="""SELECT instrument_id, date, close, row_number() OVER w - 1 AS i,
            CASE WHEN sum(volume) OVER t > 0 THEN sum(inst_net) OVER t / sum(volume) OVER t END AS buy_ratio,
            sum(CASE WHEN inst_net > 0 THEN 1 ELSE 0 END) OVER t AS buy_days,
            CASE WHEN lag(close, 19) OVER w > 0 THEN close / lag(close, 19) OVER w - 1 END AS ret,
            avg(close) OVER t AS ma20,
            CASE WHEN avg(volume) OVER q > 0 THEN avg(volume) OVER v / avg(volume) OVER q END AS squeeze,
            CASE WHEN max(close) OVER y > min(close) OVER y
                 THEN (close - min(close) OVER y) / (max(close) OVER y - min(close) OVER y) * 100 END AS position
          FROM d_flow
          WINDOW w AS (PARTITION BY instrument_id ORDER BY date),
                 t AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
                 v AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
                 q AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
                 y AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)""",
)
def quiet_accumulation(m: MarketTables) -> DataFrame:
    out = signals.quiet_accumulation_signals(m.flow_panel, QUIET_PARAMS)
    return rounded(out, "ret", "squeeze", "position", "score")


@query(
    "revenue_momentum_signals",
    """SELECT date, instrument_id, ym, pub_date, yoy, cum_yoy,
              round(least(yoy, 150) + least(cum_yoy, 100) * 0.5 + least(yoy - cum_yoy, 100), 6) AS score
       FROM (SELECT b.date, b.instrument_id, r.ym, r.pub_date, r.yoy, r.cum_yoy
             FROM d_bars b JOIN (SELECT *, lead(pub_date) OVER (PARTITION BY instrument_id ORDER BY pub_date, ym) AS until FROM d_revp) r
               ON r.instrument_id = b.instrument_id AND b.date >= r.pub_date AND (until IS NULL OR b.date < until))
       WHERE yoy BETWEEN 30 AND 300 AND cum_yoy BETWEEN 2 AND 200 AND yoy - cum_yoy >= 5""",
)
def revenue_momentum(m: MarketTables) -> DataFrame:
    out = signals.revenue_momentum_signals(m.bars, m.revenue_panel, RevenueMomentum(min_cum=2.0))
    return rounded(out, "score")


VALUE_PARAMS = Value(min_yield=4.0, max_per=26.0, max_pbr=2.5, min_roe=7.0)


@query(
    "value_signals",
    """SELECT date, instrument_id, round(roe, 6) AS roe_est, round("yield" * 3 + 100 / greatest(per, 1) + roe * 1.5, 6) AS score
       FROM (SELECT *, pbr / per * 100 AS roe FROM d_val)
       WHERE "yield" >= 4 AND per > 0 AND per <= 26 AND pbr > 0 AND pbr <= 2.5 AND roe >= 7
         AND instrument_id IN (SELECT instrument_id FROM d_bars)""",
)
def value(m: MarketTables) -> DataFrame:
    return rounded(signals.value_signals(m.valuation, m.bars, VALUE_PARAMS), "roe_est", "score")


@query(
    "regime_gate",
    """SELECT date, round(p, 6) AS pct_above, coalesce(p >= 45, true) AS regime_ok
       FROM d_cal LEFT JOIN (
         SELECT date, avg(CASE WHEN close >= m THEN 1e0 ELSE 0e0 END) * 100 AS p
         FROM (SELECT date, close, avg(close) OVER w AS m, count(*) OVER w AS n FROM d_bars
               WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
         WHERE n = 20 GROUP BY date) USING (date)""",
)
def regime(m: MarketTables) -> DataFrame:
    return rounded(signals.regime_gate(m.bars, m.calendar), "pct_above")


@query(
    "asof_join",
    """SELECT b.date, b.instrument_id, r.ym, r.pub_date, r.yoy
       FROM d_bars b ASOF LEFT JOIN d_revp r ON b.instrument_id = r.instrument_id AND b.date >= r.pub_date""",
)
def asof(m: MarketTables) -> DataFrame:
    return joins.asof_join(
        m.bars.select("instrument_id", "date"), m.revenue_panel.select("instrument_id", "pub_date", "ym", "yoy"),
        "date", "pub_date", tie_break=["ym"],
    )
