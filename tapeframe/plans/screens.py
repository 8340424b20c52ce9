"""As-of screens, flow signals and technical tables with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Accumulation, DayTrade, LockScreen, MainForce, RelativeStrength, RevenueMomentum
from ..operators import flows, screens, technical
from ..operators import fundamentals as fund
from ..sources.landing import MarketTables
from .registry import query, rounded

SCREEN_ACCUM = Accumulation(
    allowed_missing=5, min_streak=1, min_gain=-0.9, max_gain=5.0, min_buy_ratio=0.01, max_margin_increase=5.0,
    max_above_ma20=5.0, min_avg_volume=10, min_avg_volume_tpex=20,
)
ACCUM_BODY = """
    SELECT w.instrument_id, instrument_name, type AS market, CASE WHEN type = 'tpex' THEN 'foreign' ELSE 'trust' END AS investor,
           (SELECT d FROM sc_asof) AS asof_date, c1 AS close, round((c1 - c0) / c0 * 100, 6) AS gain_pct,
           streak, cum_net, round(cum_net / tv * 100, 6) AS buy_ratio_pct, round(mc * 100, 6) AS margin_change_pct,
           round(av, 6) AS avg_volume, round(cum_net / tv * 200 + streak * 3 + (c1 - c0) / c0 * 100, 6) AS score
    FROM sc_win w JOIN d_info USING (instrument_id) JOIN sc_streak USING (instrument_id) JOIN sc_margin USING (instrument_id)
         LEFT JOIN sc_ma USING (instrument_id)
    WHERE n >= 5 AND c0 > 0 AND av >= CASE WHEN type = 'tpex' THEN 20 ELSE 10 END
      AND (c1 - c0) / c0 < 5 AND (c1 - c0) / c0 >= -0.9 AND streak >= {streak}
      AND cum_net / tv >= 0.01 AND mc <= 5 AND (ma IS NULL OR (c1 - ma) / ma <= 5)"""
ACCUM_CTES = {
    "sc_asof": "SELECT min(d) AS d FROM (SELECT type, max(date) AS d FROM d_inst JOIN d_info USING (instrument_id) GROUP BY type)",
    "sc_dates": "SELECT date FROM (SELECT DISTINCT date FROM d_inst) WHERE date <= (SELECT d FROM sc_asof) ORDER BY date DESC LIMIT 10",
    "sc_win": """SELECT instrument_id, count(*) AS n, avg(volume) AS av, sum(volume) AS tv, arg_min(close, date) AS c0,
                 arg_max(close, date) AS c1 FROM d_bars WHERE date IN (SELECT date FROM sc_dates) GROUP BY instrument_id""",
    "sc_net": """SELECT instrument_id, date, CASE WHEN type = 'tpex' THEN foreign_net ELSE trust_net END AS v,
                 row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn
                 FROM d_inst JOIN d_info USING (instrument_id) WHERE date IN (SELECT date FROM sc_dates)""",
    "sc_streak": """SELECT a.instrument_id, sum(a.v) AS cum_net,
                 CAST(sign(max(CASE WHEN rn = 1 THEN v END)) * (coalesce(min(CASE WHEN v = 0 OR sign(v) <> s THEN rn END), max(rn) + 1) - 1) AS BIGINT) AS streak
                 FROM sc_net a JOIN (SELECT instrument_id, sign(v) AS s FROM sc_net WHERE rn = 1) b USING (instrument_id) GROUP BY a.instrument_id""",
    "sc_margin": """SELECT instrument_id, CASE WHEN count(*) >= 2 AND arg_min(margin_balance, date) <> 0
                 THEN (arg_max(margin_balance, date) - arg_min(margin_balance, date)) / abs(arg_min(margin_balance, date)) ELSE 0 END AS mc
                 FROM d_margin GROUP BY instrument_id""",
    "sc_ma": """SELECT instrument_id, avg(close) AS ma FROM (SELECT instrument_id, close, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn
                 FROM d_bars WHERE date <= (SELECT d FROM sc_asof)) WHERE rn <= 20 GROUP BY instrument_id HAVING count(*) = 20""",
}


@query("accumulation_screen_soft", ACCUM_BODY.format(streak=1), **ACCUM_CTES)
def accumulation_soft(m: MarketTables) -> DataFrame:
    return _accum(m, 1)


@query("accumulation_screen", ACCUM_BODY.format(streak=2), **ACCUM_CTES)
def accumulation_strict(m: MarketTables) -> DataFrame:
    return _accum(m, 2)


def _accum(m: MarketTables, streak: int) -> DataFrame:
    out = screens.accumulation_screen(m.bars, m.institutional, m.margin, m.instruments, SCREEN_ACCUM, streak)
    return rounded(out, "gain_pct", "buy_ratio_pct", "margin_change_pct", "avg_volume", "score")


LAST = "date IN (SELECT date FROM d_cal WHERE age <= {n})"
SCREEN_RS = RelativeStrength(lookback=10, max_return=3.0, min_avg_volume=20, min_avg_volume_tpex=30)


@query(
    "relative_strength_screen",
    f"""SELECT instrument_id, instrument_name, type AS market, round(ret * 100, 6) AS return_pct,
              round((ret - (SELECT median(ret) FROM rsx)) * 100, 6) AS vs_market_pct, round(av, 6) AS avg_volume
       FROM rsx JOIN d_info USING (instrument_id)
       WHERE ret BETWEEN 0 AND 3 AND av >= CASE WHEN type = 'tpex' THEN 30 ELSE 20 END""",
    rsx=f"""SELECT instrument_id, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) AS ret, avg(volume) AS av
        FROM d_bars WHERE {LAST.format(n=10)} GROUP BY instrument_id HAVING count(*) >= 9 AND arg_min(close, date) > 0""",
)
def relative_strength(m: MarketTables) -> DataFrame:
    out = screens.relative_strength_screen(m.bars, m.instruments, m.days, SCREEN_RS)
    return rounded(out, "return_pct", "vs_market_pct", "avg_volume")


SCREEN_REV = RevenueMomentum(
    min_yoy=5.0, max_yoy=500.0, min_cum=-20.0, min_accel=1.0, min_avg_volume=10, exclude_industries=("NATION_1",)
)
LATEST_REV = """SELECT *, CASE WHEN before > 0 THEN round((revenue - before) / before * 100, 1) END AS mom FROM (
        SELECT a.instrument_id, p.ym, p.yoy, p.cum_yoy, a.revenue, b.revenue AS before,
            row_number() OVER (PARTITION BY a.instrument_id ORDER BY a.year DESC, a.month DESC) AS rn
        FROM d_rev a JOIN d_revp p ON p.instrument_id = a.instrument_id AND p.ym = strftime(make_date(a.year, a.month, 1), '%Y-%m')
        LEFT JOIN d_rev b ON b.instrument_id = a.instrument_id AND b.year * 12 + b.month = a.year * 12 + a.month - 1) WHERE rn = 1"""
LAST20 = """SELECT instrument_id, CASE WHEN count(*) = 20 THEN avg(close) END AS ma, arg_max(close, date) AS c, avg(volume) AS av
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM d_bars) WHERE rn <= 20 GROUP BY instrument_id"""


@query(
    "revenue_momentum_screen",
    """SELECT instrument_id, instrument_name, type AS market, industry, c AS close, ym, yoy, cum_yoy, mom,
              round(yoy - cum_yoy, 6) AS acceleration, coalesce(c >= ma, false) AS above_ma20,
              round(least(yoy, 150) + least(cum_yoy, 100) * 0.5 + least(yoy - cum_yoy, 100)
                    + CASE WHEN c >= ma THEN 10 ELSE 0 END, 6) AS score
       FROM latest_rev JOIN d_info USING (instrument_id) JOIN last20 USING (instrument_id)
       WHERE yoy BETWEEN 5 AND 500 AND cum_yoy BETWEEN -20 AND 200 AND yoy - cum_yoy >= 1
         AND NOT contains(industry, 'NATION_1') AND c >= 10 AND av >= 10""",
    latest_rev=LATEST_REV, last20=LAST20,
)
def revenue_momentum(m: MarketTables) -> DataFrame:
    out = screens.revenue_momentum_screen(fund.latest_revenue(m.revenue), m.bars, m.instruments, SCREEN_REV)
    return rounded(out, "acceleration", "score")


SCREEN_DT = DayTrade(min_rows=10, min_avg_volume=20, min_avg_volume_tpex=25, min_avg_amplitude=4.5)


@query(
    "day_trade_candidates",
    """SELECT instrument_id, instrument_name, type AS market, close, round(amp, 6) AS amp_today, round(aa, 6) AS avg_amp,
              round(v / av, 6) AS surge, round(av, 6) AS avg_volume,
              round(aa * log10(greatest(floor(av), 10)) + greatest(v / av - 1, 0) * 5, 6) AS score
       FROM dtc JOIN d_info USING (instrument_id)
       WHERE n >= 10 AND aa >= 4.5 AND av >= CASE WHEN type = 'tpex' THEN 25 ELSE 20 END""",
    dtc=f"""SELECT instrument_id, count(*) AS n, avg(volume) AS av, avg(amp) AS aa, arg_max(close, date) AS close,
              arg_max(amp, date) AS amp, arg_max(volume, date) AS v
            FROM (SELECT *, (high - low) / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) * 100 AS amp
                  FROM d_bars WHERE {LAST.format(n=20)}) GROUP BY instrument_id""",
)
def day_trade_candidates(m: MarketTables) -> DataFrame:
    return rounded(_candidates(m), "amp_today", "avg_amp", "surge", "avg_volume", "score")


def _candidates(m: MarketTables) -> DataFrame:
    return screens.day_trade_candidates(m.bars, m.instruments, m.days, SCREEN_DT)


SCREEN_MF = MainForce(min_avg_volume=10)
MAIN_FORCE = {
    "mf_holder": """SELECT instrument_id, round(max(pct_1000) FILTER (WHERE k = 1), 2) AS holder_pct,
            round(max(pct_1000) FILTER (WHERE k = 1) - max(pct_1000) FILTER (WHERE k = 2), 2) AS holder_change
        FROM d_hold JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM d_hold)) USING (date)
        WHERE k <= 2 GROUP BY instrument_id HAVING count(*) FILTER (WHERE k = 1) > 0""",
    "mf": f"""SELECT b.instrument_id, instrument_name, type AS market, close, net AS inst_net, net / vol * 100 AS inst_pct,
            holder_pct, holder_change, mc AS margin_change_pct,
            net / vol * 100 * 2 + coalesce(holder_change, 0) * 3 - mc AS score
        FROM (SELECT instrument_id, arg_max(close, date) AS close, avg(volume) AS av, sum(volume) AS vol,
                     sum(foreign_net + trust_net + dealer_net) AS net FROM d_panel WHERE {LAST.format(n=10)} GROUP BY instrument_id) b
        LEFT JOIN mf_holder USING (instrument_id) LEFT JOIN d_info USING (instrument_id)
        LEFT JOIN (SELECT instrument_id, CASE WHEN count(*) >= 2 AND arg_min(margin_balance, date) > 0
                THEN (arg_max(margin_balance, date) - arg_min(margin_balance, date)) / arg_min(margin_balance, date) * 100 ELSE 0 END AS mc
              FROM d_margin GROUP BY instrument_id) USING (instrument_id)
        WHERE close >= 10 AND av >= 10 AND vol > 0""",
}


def _force(m: MarketTables) -> DataFrame:
    return screens.main_force_score(
        m.bars, m.institutional, m.margin, flows.holder_change(m.big_holders), m.instruments, m.days, SCREEN_MF
    )


@query(
    "main_force_score",
    """SELECT instrument_id, instrument_name, market, close, inst_net, round(inst_pct, 6) AS inst_pct, holder_pct, holder_change,
              round(margin_change_pct, 6) AS margin_change_pct, round(score, 6) AS score FROM mf""",
    **MAIN_FORCE,
)
def main_force(m: MarketTables) -> DataFrame:
    return rounded(_force(m), "inst_pct", "margin_change_pct", "score")


@query(
    "day_trade_bias",
    """SELECT instrument_id, votes, CASE WHEN votes >= 2 THEN 'bull' WHEN votes <= -2 THEN 'bear' ELSE 'neutral' END AS bias,
              CASE WHEN abs(votes) < 2 THEN '-' WHEN votes >= 2 THEN 'with' ELSE 'against' END AS alignment
       FROM (SELECT c.instrument_id, CAST(
                coalesce(CASE WHEN inst_pct > 3 THEN 1 WHEN inst_pct < -3 THEN -1 END, 0)
              + coalesce(CASE WHEN holder_change > 0.3 THEN 1 WHEN holder_change < -0.3 THEN -1 END, 0)
              + coalesce(CASE WHEN margin_change_pct < -5 THEN 1 WHEN margin_change_pct > 15 THEN -1 END, 0)
              + coalesce(CASE WHEN ret - med > 5 THEN 1 WHEN ret - med < -5 THEN -1 END, 0)
              + CASE WHEN ma IS NULL THEN 0 WHEN c.close > ma THEN 1 ELSE -1 END AS INTEGER) AS votes
             FROM (SELECT instrument_id, arg_max(close, date) AS close, count(*) AS n, avg(amp) AS aa, avg(volume) AS av FROM
                     (SELECT *, (high - low) / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) * 100 AS amp
                      FROM d_bars WHERE date IN (SELECT date FROM d_cal WHERE age <= 20)) GROUP BY instrument_id) c
             JOIN d_info USING (instrument_id)
             LEFT JOIN mf USING (instrument_id) LEFT JOIN bias_ctx USING (instrument_id), (SELECT median(ret) AS med FROM bias_ctx)
             WHERE n >= 10 AND aa >= 4.5 AND av >= CASE WHEN type = 'tpex' THEN 25 ELSE 20 END)""",
    bias_ctx="""SELECT instrument_id, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS ret,
                CASE WHEN count(*) = 20 THEN avg(close) END AS ma
                FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM d_bars) WHERE rn <= 20 GROUP BY instrument_id""",
    **MAIN_FORCE,
)
def day_trade_bias(m: MarketTables) -> DataFrame:
    out = screens.day_trade_bias(_candidates(m), _force(m), m.bars, regime_direction=1)
    return out.select("instrument_id", "votes", "bias", "alignment")


BREADTH = """SELECT (SELECT max(date) FROM d_cal) AS date, up, down, flat, round(share * 100, 1) AS pct_above_ma20 FROM
    (SELECT count(*) FILTER (WHERE x > 0) AS up, count(*) FILTER (WHERE x < 0) AS down, count(*) FILTER (WHERE x = 0) AS flat
     FROM (SELECT instrument_id, arg_max(close, date) - arg_min(close, date) AS x FROM d_bars
           WHERE date IN (SELECT date FROM d_cal WHERE age <= 2) GROUP BY instrument_id HAVING count(*) = 2)),
    (SELECT avg(CASE WHEN c > ma THEN 1e0 ELSE 0e0 END) AS share FROM last20 WHERE ma IS NOT NULL)"""
POSTURE = """CASE WHEN pct_above_ma20 >= 60 AND q > 1 THEN 'bull' WHEN pct_above_ma20 <= 30 THEN 'bear'
    WHEN q >= 2 THEN 'broad up' WHEN q <= 0.5 THEN 'broad down' ELSE 'neutral' END"""


@query(
    "market_breadth",
    f"""SELECT date, up, down, flat, pct_above_ma20, {POSTURE} AS posture
        FROM (SELECT *, CASE WHEN down > 0 THEN up / down ELSE 999 END AS q FROM breadth)""",
    breadth=BREADTH, last20=LAST20,
)
def breadth(m: MarketTables) -> DataFrame:
    return screens.market_breadth(m.bars, m.calendar)


@query(
    "regime_level",
    f"""SELECT date, up, down, flat, pct_above_ma20, {POSTURE} AS posture,
          CASE WHEN pct_above_ma20 >= 60 THEN 'bull' WHEN pct_above_ma20 >= 45 THEN 'mildly bull'
               WHEN pct_above_ma20 >= 30 THEN 'weak range' ELSE 'bear' END AS regime,
          CASE WHEN pct_above_ma20 >= 60 THEN '70-100%' WHEN pct_above_ma20 >= 45 THEN '40-60%'
               WHEN pct_above_ma20 >= 30 THEN '20-30%' ELSE '0-20%' END AS suggested_exposure,
          CASE WHEN pct_above_ma20 >= 60 THEN 'select actively' WHEN pct_above_ma20 >= 45 THEN 'be strict, control size'
               WHEN pct_above_ma20 >= 30 THEN 'strongest only, tight stops' ELSE 'mostly cash' END AS advice
        FROM (SELECT *, CASE WHEN down > 0 THEN up / down ELSE 999 END AS q FROM breadth)""",
    breadth=BREADTH, last20=LAST20,
)
def regime(m: MarketTables) -> DataFrame:
    return screens.regime_level(screens.market_breadth(m.bars, m.calendar))


SCREEN_LOCK = LockScreen()


@query(
    "limit_up_candidates",
    """SELECT date, prev_date, instrument_id, open, close, volume, round(chg, 6) AS change_pct, close * volume / 1e5 AS turnover,
              CAST(rk AS INTEGER) AS rank
       FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close * volume / 1e5 DESC, instrument_id) AS rk FROM
         (SELECT b.date, c.prev_date, b.instrument_id, b.open, b.close, b.volume, (b.close - p.close) / p.close * 100 AS chg
          FROM d_bars b JOIN d_cal c ON b.date = c.date JOIN d_bars p ON p.instrument_id = b.instrument_id AND p.date = c.prev_date
          WHERE p.close > 0 AND b.volume > 0 AND (b.close - p.close) / p.close * 100 >= 9)) WHERE rk <= 15""",
)
def limit_up(m: MarketTables) -> DataFrame:
    return rounded(screens.limit_up_candidates(m.bars, m.calendar, every_date=True), "change_pct")


def _streak(c: str, out: str) -> str:
    return f"""CAST(coalesce(max(CASE WHEN rn = 1 THEN sign({c}) END), 0) *
        (coalesce(min(CASE WHEN {c} = 0 OR sign({c}) <> s_{out} THEN rn END), max(rn) + 1) - 1) AS BIGINT) AS {out}_streak"""


CHIP = f"""SELECT k.*, round(CASE WHEN t.volume > 0 THEN (t.f + t.t + t.d) / t.volume * 100 END, 6) AS dominance_pct,
       t.volume AS volume_today, round(t.volume / av, 6) AS volume_ratio,
       round(CASE WHEN t.m > 0 THEN t.s / t.m * 100 END, 6) AS short_margin_pct,
       round(CASE WHEN t.volume > 0 THEN (t.m - t.pm) / t.volume * 100 END, 6) AS margin_volume_pct,
       round(CASE WHEN t.volume > 0 THEN (t.s - t.ps) / t.volume * 100 END, 6) AS short_volume_pct,
       t.f AS f_today, t.t AS t_today
    FROM (SELECT instrument_id, {_streak('foreign_net', 'foreign')}, {_streak('trust_net', 'trust')}, {_streak('dealer_net', 'dealer')}
          FROM (SELECT *, first_value(sign(foreign_net)) OVER w AS s_foreign, first_value(sign(trust_net)) OVER w AS s_trust,
                       first_value(sign(dealer_net)) OVER w AS s_dealer, row_number() OVER w AS rn
                FROM d_inst WHERE {LAST.format(n=30)} WINDOW w AS (PARTITION BY instrument_id ORDER BY date DESC)) GROUP BY instrument_id) k
    LEFT JOIN (SELECT p.instrument_id, max(foreign_net) FILTER (WHERE age = 1) AS f, max(trust_net) FILTER (WHERE age = 1) AS t,
                 max(dealer_net) FILTER (WHERE age = 1) AS d, max(volume) FILTER (WHERE age = 1) AS volume,
                 max(margin_balance) FILTER (WHERE age = 1) AS m, max(margin_balance) FILTER (WHERE age = 2) AS pm,
                 max(short_balance) FILTER (WHERE age = 1) AS s, max(short_balance) FILTER (WHERE age = 2) AS ps,
                 avg(volume) AS av
               FROM d_panel p JOIN d_cal USING (date) WHERE age <= 20 GROUP BY p.instrument_id) t USING (instrument_id)"""
CHIP_LABEL = """list_aggregate(list_filter([
      CASE WHEN f_today > 0 AND t_today > 0 THEN 'both buy' WHEN f_today < 0 AND t_today < 0 THEN 'both sell' END,
      CASE WHEN foreign_streak >= 5 THEN concat('foreign buys ', foreign_streak) WHEN foreign_streak <= -5 THEN concat('foreign sells ', -foreign_streak) END,
      CASE WHEN trust_streak >= 5 THEN concat('trust buys ', trust_streak) WHEN trust_streak <= -5 THEN concat('trust sells ', -trust_streak) END,
      CASE WHEN dealer_streak >= 5 THEN concat('dealer buys ', dealer_streak) WHEN dealer_streak <= -5 THEN concat('dealer sells ', -dealer_streak) END],
      lambda x: x IS NOT NULL)[1:2], 'string_agg', '|')"""


@query(
    "chip_signals",
    f"""SELECT * EXCLUDE (f_today, t_today), coalesce(nullif({CHIP_LABEL}, ''), '-') AS chip_label FROM chip""",
    chip=CHIP,
)
def chip(m: MarketTables) -> DataFrame:
    out = flows.chip_signals(m.institutional, m.bars, m.margin, m.days, flow_days=m.days, balance_days=m.days)
    return rounded(out, "dominance_pct", "volume_ratio", "short_margin_pct", "margin_volume_pct", "short_volume_pct")


def behind(df: DataFrame) -> DataFrame:
    """The table without its newest date."""
    return df.filter(F.col("date") < df.agg(F.max("date").alias("d")).select("d").scalar())


def lagging(sql: str) -> str:
    """Flow and margin ages one date later; the prices keep theirs."""
    older = sql.replace(LAST.format(n=30), "date IN (SELECT date FROM d_cal WHERE age BETWEEN 2 AND 31)")
    for column in ("foreign_net", "trust_net", "dealer_net", "margin_balance", "short_balance"):
        older = older.replace(f"max({column}) FILTER (WHERE age = 2)", f"max({column}) FILTER (WHERE age = 3)").replace(
            f"max({column}) FILTER (WHERE age = 1)", f"max({column}) FILTER (WHERE age = 2)")
    older = older.replace("avg(volume) AS av", "max(volume) FILTER (WHERE age = 2) AS vs, avg(volume) AS av")
    return older.replace("CASE WHEN t.volume > 0 THEN (t.f + t.t + t.d) / t.volume * 100 END", "CASE WHEN t.vs > 0 THEN (t.f + t.t + t.d) / t.vs * 100 END")


@query(
    "chip_signals_lagging",
    f"""SELECT * EXCLUDE (f_today, t_today), coalesce(nullif({CHIP_LABEL}, ''), '-') AS chip_label FROM chip""",
    chip=lagging(CHIP),
)
def chip_lagging(m: MarketTables) -> DataFrame:
    """Flows and balances one date behind the prices."""
    out = flows.chip_signals(behind(m.institutional), m.bars, behind(m.margin), m.calendar)
    return rounded(out, "dominance_pct", "volume_ratio", "short_margin_pct", "margin_volume_pct", "short_volume_pct")


TECH = """SELECT instrument_id,
      CASE WHEN n < 20 THEN '-' WHEN m5 > m10 AND m10 > m20 THEN 'bull' WHEN m5 < m10 AND m10 < m20 THEN 'bear' ELSE 'mixed' END AS ma_align,
      CASE WHEN n < 60 THEN '-' WHEN n < 240 THEN CASE WHEN c > m60 THEN 'above season' ELSE 'below season' END
           WHEN c > m60 AND c > m240 THEN 'above both' WHEN c > m60 THEN 'above season' WHEN c > m240 THEN 'above year' ELSE 'below both' END AS long_term,
      CASE WHEN n < 120 THEN '-' WHEN c > m120 THEN 'above half year' ELSE 'below half year' END AS half_year,
      round(CASE WHEN n >= 20 THEN (c - m20) / m20 * 100 END, 6) AS bias20_pct,
      round(CASE WHEN n >= 120 AND hi > lo THEN (c - lo) / (hi - lo) * 100 END, 6) AS year_position_pct,
      c * v / 1e5 AS turnover
    FROM (SELECT instrument_id, count(*) AS n, max(close) AS hi, min(close) AS lo, arg_max(close, date) AS c, arg_max(volume, date) AS v,
            avg(close) FILTER (WHERE rn <= 5) AS m5, avg(close) FILTER (WHERE rn <= 10) AS m10, avg(close) FILTER (WHERE rn <= 20) AS m20,
            avg(close) FILTER (WHERE rn <= 60) AS m60, avg(close) FILTER (WHERE rn <= 120) AS m120, avg(close) AS m240
          FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM d_bars) WHERE rn <= 240 GROUP BY instrument_id)"""


@query("tech_signals", "SELECT * FROM tech", tech=TECH)
def tech(m: MarketTables) -> DataFrame:
    return rounded(technical.tech_signals(m.bars), "bias20_pct", "year_position_pct")


def flow_window_sql(n: int) -> str:
    return f"""SELECT instrument_id, sum(foreign_net) AS foreign_net, sum(trust_net) AS trust_net, sum(dealer_net) AS dealer_net,
       round(arg_max(margin_balance, date) - arg_min(margin_balance, date), 6) AS margin_change,
       round(arg_max(short_balance, date) - arg_min(short_balance, date), 6) AS short_change
     FROM d_panel WHERE {LAST.format(n=n)} GROUP BY instrument_id"""


@query("flow_windows", flow_window_sql(10))
def flow_windows(m: MarketTables) -> DataFrame:
    return rounded(flows.flow_windows(m.institutional, m.margin, 10), "margin_change", "short_change")


DAY_PRIOR = """SELECT coalesce(c.instrument_id, p.instrument_id) AS instrument_id, foreign_net AS foreign_net_prior, trust_net AS trust_net_prior, dealer_net AS dealer_net_prior,
          round(c.margin_balance - p.pm, 6) AS margin_change_prior, round(c.short_balance - p.ps, 6) AS short_change_prior
       FROM (SELECT * FROM d_panel WHERE date = (SELECT date FROM d_cal WHERE age = 2)) c
       LEFT JOIN (SELECT instrument_id, margin_balance AS pm, short_balance AS ps FROM d_panel
                  WHERE date = (SELECT date FROM d_cal WHERE age = 3)) p USING (instrument_id)"""


@query("day_flows", DAY_PRIOR)
def day_flows(m: MarketTables) -> DataFrame:
    out = flows.day_flows(m.institutional, m.margin, 1, "_prior")
    return rounded(out, "margin_change_prior", "short_change_prior")


@query("day_flows_lagging", DAY_PRIOR.replace("_prior", "_today"))
def day_flows_lagging(m: MarketTables) -> DataFrame:
    """Flows and balances one date behind the prices: their own newest date counts."""
    out = flows.day_flows(behind(m.institutional), behind(m.margin))
    return rounded(out, "margin_change_today", "short_change_today")


@query(
    "today_price",
    """SELECT c.instrument_id, c.close AS close_today, round(CASE WHEN p.close > 0 THEN (c.close - p.close) / p.close * 100 END, 6) AS change_today_pct
       FROM (SELECT * FROM d_bars WHERE date = (SELECT date FROM d_cal WHERE age = 1)) c
       LEFT JOIN (SELECT * FROM d_bars WHERE date = (SELECT date FROM d_cal WHERE age = 2)) p USING (instrument_id)""",
)
def today_price(m: MarketTables) -> DataFrame:
    return rounded(flows.today_price(m.bars, m.calendar), "change_today_pct")


@query(
    "day_trade_ratio",
    "SELECT instrument_id, round(dt_vol / volume * 100, 6) AS day_trade_pct FROM d_panel WHERE date = (SELECT max(date) FROM d_cal) AND volume > 0",
)
def day_trade_ratio(m: MarketTables) -> DataFrame:
    return rounded(flows.day_trade_ratio(m.day_trade, m.bars, m.calendar), "day_trade_pct")


DAY_TREND = """SELECT instrument_id, round(avg(x), 6) AS day_trade_mean_pct,
          CASE WHEN avg(x) FILTER (WHERE rn > 1) > 0 AND max(x) FILTER (WHERE rn = 1) > avg(x) FILTER (WHERE rn > 1) * 1.2 THEN 'heating'
               WHEN avg(x) FILTER (WHERE rn > 1) > 0 AND max(x) FILTER (WHERE rn = 1) < avg(x) FILTER (WHERE rn > 1) * 0.8 THEN 'cooling'
               ELSE 'steady' END AS day_trade_heat
       FROM (SELECT instrument_id, dt_vol / volume * 100 AS x, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn
             FROM d_panel WHERE volume > 0) WHERE rn <= 5 GROUP BY instrument_id HAVING count(*) >= 2"""


@query("day_trade_trend", DAY_TREND)
def day_trade_trend(m: MarketTables) -> DataFrame:
    return rounded(flows.day_trade_trend(m.day_trade, m.bars), "day_trade_mean_pct")


@query(
    "sbl_latest",
    """SELECT instrument_id, sbl_balance, sbl_change, sbl_date, age - 1 AS stale_dates FROM
         (SELECT instrument_id, arg_max(sbl_balance, date) AS sbl_balance, max(date) AS sbl_date,
                 CASE WHEN count(*) = 2 THEN arg_max(sbl_balance, date) - arg_min(sbl_balance, date) END AS sbl_change
          FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM d_sbl) WHERE rn <= 2 GROUP BY instrument_id)
       JOIN d_cal ON sbl_date = date WHERE age - 1 <= 5""",
)
def sbl_latest(m: MarketTables) -> DataFrame:
    return flows.sbl_latest(m.sbl, m.calendar)


@query(
    "holder_trend",
    """SELECT instrument_id, date, pct_1000, pct_400, round(pct_1000 - lag(pct_1000) OVER (PARTITION BY instrument_id ORDER BY date), 2) AS pct_1000_change
       FROM d_hold""",
)
def holder_trend(m: MarketTables) -> DataFrame:
    return flows.holder_trend(m.big_holders)


@query("holder_change", "SELECT * FROM mf_holder", mf_holder=MAIN_FORCE["mf_holder"])
def holder_change(m: MarketTables) -> DataFrame:
    return flows.holder_change(m.big_holders)


SHARE = """SELECT s.instrument_id, round(foreign_pct, 6) AS foreign_pct, round(close * shares_issued / 1e8, 6) AS market_value,
      round(volume / (shares_issued / 1000) * 100, 6) AS turnover_pct
    FROM d_share s JOIN d_bars b ON b.instrument_id = s.instrument_id AND b.date = (SELECT max(date) FROM d_cal)
    WHERE s.date = (SELECT max(date) FROM d_share WHERE date > (SELECT max(date) FROM d_cal) - INTERVAL 3 DAY AND date <= (SELECT max(date) FROM d_cal))"""


@query("share_stats", SHARE)
def share_stats(m: MarketTables) -> DataFrame:
    return rounded(flows.share_stats(m.shareholding, m.bars, m.calendar), "foreign_pct", "market_value", "turnover_pct")


RISK = """SELECT instrument_id, close, atr, CASE WHEN close - atr * 2 > 0 THEN close - atr * 2 END AS stop
    FROM (SELECT instrument_id, arg_max(close, date) AS close, avg(tr) AS atr, count(*) AS n FROM
      (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM
        (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
         FROM d_bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date))) WHERE rn <= 14 GROUP BY instrument_id)
    WHERE n >= 14 AND atr > 0"""


@query(
    "risk_levels",
    """SELECT instrument_id, close, round(atr, 6) AS atr, round(stop, 6) AS stop, round((stop - close) / close * 100, 6) AS stop_pct,
              round(close + (close - stop) * 2, 6) AS target FROM risk""",
    risk=RISK,
)
def risk_levels(m: MarketTables) -> DataFrame:
    return rounded(technical.risk_levels(m.bars), "atr", "stop", "stop_pct", "target")


@query(
    "position_sizing",
    """SELECT account_id, instrument_id, entry, round(stop, 2) AS stop, CASE WHEN lots >= 1 THEN lots END AS lots,
          CASE WHEN lots >= 1 THEN round(entry + risk * 2, 6) END AS target, CASE WHEN lots >= 1 THEN round(lots * 1000 * entry, 4) END AS position_value,
          CASE WHEN lots >= 1 THEN round(lots * 1000 * risk, 4) END AS risk_amount,
          CASE WHEN lots >= 1 THEN round(lots * 1000 * risk / account * 100, 6) END AS risk_of_account_pct, by_risk > by_size AS capped,
          CASE WHEN entry IS NULL THEN 'too few bars for a range' WHEN risk <= 0 THEN 'no distance to the stop' WHEN account IS NULL THEN 'no balance'
               WHEN lots < 1 THEN 'less than one lot' END AS note
       FROM (SELECT *, CASE WHEN by_risk IS NOT NULL AND by_size IS NOT NULL THEN least(by_risk, by_size) END AS lots FROM (SELECT *,
               CASE WHEN risk > 0 THEN CAST(floor(floor(account * 1 / 100 / risk) / 1000) AS BIGINT) END AS by_risk,
               CASE WHEN risk > 0 THEN CAST(floor(account * 25 / 100 / (entry * 1000)) AS BIGINT) END AS by_size
             FROM (SELECT account_id, q.instrument_id, account, close AS entry, round(close - (floor(round(atr * 100, 4) + 0.5) / 100) * 2, 2) AS stop,
                          close - round(close - (floor(round(atr * 100, 4) + 0.5) / 100) * 2, 2) AS risk FROM d_requests q LEFT JOIN risk r ON r.instrument_id = q.instrument_id)))""",
    risk=RISK,
)
def position_sizing(m: MarketTables) -> DataFrame:
    out = technical.position_sizing(m.sizing_requests, technical.risk_levels(m.bars))
    out = rounded(out, "target", "risk_of_account_pct")
    return rounded(out, "position_value", "risk_amount", digits=4)


@query(
    "ma_series",
    """SELECT instrument_id, date, close, round(CASE WHEN count(*) OVER a = 5 THEN avg(close) OVER a END, 6) AS ma5,
          round(CASE WHEN count(*) OVER b = 20 THEN avg(close) OVER b END, 6) AS ma20,
          round(CASE WHEN count(*) OVER c = 60 THEN avg(close) OVER c END, 6) AS ma60
       FROM d_bars WINDOW a AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         c AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)
def ma_series(m: MarketTables) -> DataFrame:
    return rounded(technical.ma_series(m.bars), "ma5", "ma20", "ma60")


TIMELINE = """SELECT * EXCLUDE rn FROM (SELECT p.instrument_id, p.date, p.close, p.volume,
        round((p.close - lag(p.close) OVER w) / lag(p.close) OVER w * 100, 6) AS change_pct,
        foreign_net, trust_net, dealer_net, round(p.margin_balance - lag(p.margin_balance) OVER w, 6) AS margin_change,
        round(p.short_balance - lag(p.short_balance) OVER w, 6) AS short_change, s.sbl_balance, s.sbl_change,
        row_number() OVER (PARTITION BY p.instrument_id ORDER BY p.date DESC) AS rn
      FROM d_panel p LEFT JOIN (SELECT instrument_id, date, sbl_balance, sbl_balance - lag(sbl_balance) OVER (PARTITION BY instrument_id ORDER BY date) AS sbl_change FROM d_sbl) s
        ON s.instrument_id = p.instrument_id AND s.date = p.date
      WINDOW w AS (PARTITION BY p.instrument_id ORDER BY p.date)) WHERE rn <= 30"""


@query("chip_timeline", TIMELINE)
def chip_timeline(m: MarketTables) -> DataFrame:
    return rounded(_timeline(m), "change_pct", "margin_change", "short_change")


def _timeline(m: MarketTables) -> DataFrame:
    return technical.chip_timeline(m.bars, m.institutional, m.margin, m.sbl)


@query(
    "day_trade_timeline",
    """SELECT instrument_id, date, round(dt_vol / volume * 100, 6) AS day_trade_pct FROM
       (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM d_panel) WHERE rn <= 30 AND volume > 0""",
)
def day_trade_timeline(m: MarketTables) -> DataFrame:
    return rounded(technical.day_trade_timeline(_timeline(m), m.day_trade), "day_trade_pct")


@query(
    "index_change",
    """SELECT symbol, price, prev, chg AS change_pct,
          CASE WHEN chg <= -3 THEN 'plunge' WHEN chg <= -1 THEN 'weak' WHEN chg >= 3 THEN 'surge' WHEN chg >= 1 THEN 'firm' ELSE 'flat' END AS label
       FROM (SELECT symbol, arg_max(close, date) AS price, arg_min(close, date) AS prev,
               round((arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100, 2) AS chg
             FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM idx) WHERE rn <= 2 GROUP BY symbol HAVING count(*) = 2)""",
    idx="""SELECT industry AS symbol, date, CAST(round(sum(close * 100)) AS DOUBLE) / 100e0 AS close FROM d_bars JOIN d_info USING (instrument_id) GROUP BY ALL""",
)
def index_change(m: MarketTables) -> DataFrame:
    index = m.bars.join(m.instruments, "instrument_id").groupBy(F.col("industry").alias("symbol"), "date").agg(
        (F.round(F.sum(F.col("close") * 100)) / 100.0).alias("close")
    )
    return technical.index_change(index)
