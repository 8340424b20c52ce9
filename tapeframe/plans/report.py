"""Composite tables with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Broker, LockScreen
from ..operators import brokers, events, flows, report, screens, signals, technical
from ..session import cut_lineage, shared_folder
from ..sources import normalize, tables
from ..sources.calendar import on_last_dates
from ..sources.landing import MarketTables
from . import brokers as pb
from . import fundamentals as pf
from . import screens as ps
from .brokers import FOLLOW, TOP
from .registry import query, rounded
from .signals import RS

VERDICT = """CAST(coalesce(CASE WHEN round_even(dominance_pct, 1) > 3 THEN 1 WHEN round_even(dominance_pct, 1) < -3 THEN -1 END, 0)
    + coalesce(CASE WHEN round_even(margin_volume_pct, 1) < -2 THEN 1 WHEN round_even(margin_volume_pct, 1) > 5 THEN -1 END, 0)
    + CASE ma_align WHEN 'bull' THEN 1 WHEN 'bear' THEN -1 ELSE 0 END + CASE long_term WHEN 'above both' THEN 1 WHEN 'below both' THEN -1 ELSE 0 END
    + coalesce(CASE WHEN round_even(bias20_pct, 1) > 0 THEN 1 WHEN round_even(bias20_pct, 1) < 0 THEN -1 END, 0)
    + coalesce(CASE WHEN round_even(year_position_pct, 0) > 70 THEN 1 WHEN round_even(year_position_pct, 0) < 30 THEN -1 END, 0)
    + CASE WHEN round_even(short_margin_pct, 1) > 20 THEN 1 ELSE 0 END AS INTEGER)"""
LABEL = "CASE WHEN {v} >= 3 THEN 'bull' WHEN {v} <= -3 THEN 'bear' ELSE 'watch' END"


def chip(m: MarketTables) -> DataFrame:
    return flows.chip_signals(m.institutional, m.bars, m.margin, m.days, flow_days=m.days, balance_days=m.days)


@query(
    "verdict_vote",
    f"SELECT instrument_id, votes AS verdict_votes, {LABEL.format(v='votes')} AS verdict FROM (SELECT t.instrument_id, {VERDICT} AS votes FROM tech t LEFT JOIN chip USING (instrument_id))",
    tech=ps.TECH, chip=ps.CHIP,
)
def verdict(m: MarketTables) -> DataFrame:
    return report.tech_snapshot(technical.tech_signals(m.bars), chip(m)).select("instrument_id", "verdict_votes", "verdict")


@query(
    "tech_snapshot",
    f"""SELECT instrument_id, ma_align, long_term, dominance_pct, verdict_votes, fund_votes, verdict_votes + coalesce(fund_votes, 0) AS total_votes,
          {LABEL.format(v='(verdict_votes + coalesce(fund_votes, 0))')} AS verdict
        FROM (SELECT t.instrument_id, ma_align, long_term, dominance_pct, {VERDICT} AS verdict_votes FROM tech t LEFT JOIN chip USING (instrument_id)) LEFT JOIN f_vote USING (instrument_id)""",
    tech=ps.TECH, chip=ps.CHIP, **pf.F_TABLES, **pf.F_VOTE,
)
def tech_snapshot(m: MarketTables) -> DataFrame:
    out = report.tech_snapshot(technical.tech_signals(m.bars), chip(m), pf.vote(m))
    cols = ("instrument_id", "ma_align", "long_term", "dominance_pct", "verdict_votes", "fund_votes", "total_votes", "verdict")
    return rounded(out.select(*cols), "dominance_pct")


ATTR = """SELECT instrument_id, date, chg AS change_pct, f + t + d AS inst_net, mc AS margin_change, sc AS short_change, CASE WHEN usual > 0 THEN volume / usual ELSE 0 END AS volume_ratio,
      CASE WHEN f + t + d > 0 AND up THEN 'buyers push the price' WHEN f + t + d > 0 THEN 'buyers absorb the dip' WHEN f + t + d < 0 AND up THEN 'rises against sellers'
           WHEN f + t + d < 0 THEN 'sellers lead the fall' ELSE 'neutral' END AS flow_tone,
      CASE WHEN greatest(f, t, d) > 0 AND least(f, t, d) < 0 AND least(greatest(f, t, d), -least(f, t, d)) > greatest(abs(f + t + d), 1) * 1.5
           THEN concat(CASE WHEN f = greatest(f, t, d) THEN 'foreign' WHEN t = greatest(f, t, d) THEN 'trust' ELSE 'dealer' END, ' buys against ',
                       CASE WHEN f = least(f, t, d) THEN 'foreign' WHEN t = least(f, t, d) THEN 'trust' ELSE 'dealer' END)
           ELSE concat('led by ', CASE WHEN abs(f) = greatest(abs(f), abs(t), abs(d)) THEN 'foreign' WHEN abs(t) = greatest(abs(f), abs(t), abs(d)) THEN 'trust' ELSE 'dealer' END) END AS flow_lead,
      CASE WHEN mc > 0 AND up THEN 'retail chases' WHEN mc > 0 THEN 'retail catches the knife' WHEN mc < 0 AND up THEN 'retail leaves, cleaner rise' WHEN mc < 0 THEN 'retail is stopped out' END AS margin_note,
      CASE WHEN sc > 0 THEN 'shorts enter' WHEN sc < 0 AND up THEN 'shorts squeezed' WHEN sc < 0 THEN 'shorts take profit' END AS short_note,
      CASE WHEN usual > 0 AND volume / usual >= 1.5 THEN 'surge' WHEN usual > 0 AND volume / usual < 0.7 THEN 'thin' WHEN usual > 0 THEN 'normal' END AS volume_note,
      CASE WHEN up AND f + t + d > 0 AND mc <= 0 THEN 'institutions buy, retail stays out: clean rise' WHEN up AND f + t + d > 0 THEN 'institutions and retail buy: crowded rise'
           WHEN up AND mc > 0 THEN 'retail alone chases: doubtful rise' WHEN up THEN 'no institutional buying: theme or day trade'
           WHEN f + t + d < 0 AND mc > 0 THEN 'institutions sell, retail catches: most dangerous' WHEN f + t + d < 0 THEN 'institutions lead the fall'
           WHEN mc < 0 THEN 'retail is stopped out' ELSE 'pullback without institutional selling' END AS one_line
    FROM (SELECT *, round(chg, 2) > 0 AS up FROM (SELECT instrument_id, date, volume, foreign_net AS f, trust_net AS t, dealer_net AS d,
        (close - lag(close) OVER w) / lag(close) OVER w * 100 AS chg, margin_balance - lag(margin_balance) OVER w AS mc, short_balance - lag(short_balance) OVER w AS sc,
        avg(volume) OVER (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS usual,
        row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY instrument_id) AS n
      FROM d_panel WINDOW w AS (PARTITION BY instrument_id ORDER BY date)) WHERE k = 1 AND n >= 2)"""
ATTR_OUT = """round(change_pct, 6) AS change_pct, inst_net, round(margin_change, 6) AS margin_change, round(short_change, 6) AS short_change,
    round(volume_ratio, 6) AS volume_ratio, flow_tone, flow_lead, margin_note, short_note, volume_note, one_line"""


def attribution(m: MarketTables) -> DataFrame:
    return report.move_attribution(m.bars, m.institutional, m.margin)


@query("move_attribution", f"SELECT instrument_id, date, {ATTR_OUT} FROM attr", attr=ATTR)
def move_attribution(m: MarketTables) -> DataFrame:
    return rounded(attribution(m), "change_pct", "margin_change", "short_change", "volume_ratio")


@query("holdings_attribution", "SELECT instrument_id, one_line FROM attr WHERE instrument_id IN (SELECT instrument_id FROM d_holdings)", attr=ATTR)
def holdings_attribution(m: MarketTables) -> DataFrame:
    return report.holdings_attribution(m.holdings, attribution(m))


HOLD = """SELECT h.instrument_id, instrument_name, lots, cost, close AS price, (close - cost) / cost * 100 AS profit_pct, (close - cost) * lots * 1000 AS profit,
      cost * lots * 1000 AS cost_value, CASE WHEN close > stop AND close < target THEN (close - stop) / close * 100 END AS to_stop_pct,
      CASE WHEN close <= stop THEN 'stop hit' WHEN close >= target THEN 'target hit' WHEN close IS NOT NULL THEN 'above stop' ELSE '' END AS alert
    FROM d_holdings h JOIN d_info USING (instrument_id) LEFT JOIN (SELECT instrument_id, close FROM d_bars WHERE date = (SELECT max(date) FROM d_cal)) USING (instrument_id)"""


def holding(m: MarketTables) -> DataFrame:
    return report.holding_status(m.holdings, m.bars, m.instruments, m.calendar)


@query(
    "holding_status",
    """SELECT instrument_id, instrument_name, lots, cost, price, round(profit_pct, 6) AS profit_pct, round(profit, 4) AS profit, round(cost_value, 4) AS cost_value,
          round(to_stop_pct, 6) AS to_stop_pct, alert FROM hold""", hold=HOLD,
)
def holding_status(m: MarketTables) -> DataFrame:
    return rounded(rounded(holding(m), "profit_pct", "to_stop_pct"), "profit", "cost_value", digits=4)


@query(
    "holding_totals",
    """SELECT count(*) AS n_holdings, round(sum(cost_value), 2) AS total_cost, round(sum(profit), 2) AS total_profit,
          round(sum(profit) / sum(cost_value) * 100, 6) AS total_return_pct FROM hold""", hold=HOLD,
)
def holding_totals(m: MarketTables) -> DataFrame:
    return rounded(rounded(report.holding_totals(holding(m)), "total_return_pct"), "total_cost", "total_profit", digits=2)


# ---- lock screen ---------------------------------------------------------

LOCK_B = Broker(top=TOP, min_ops=10, hot=26, mid=25, long=24)
LOCK_P = LockScreen(lookback=40)
LOCK = {
    **{k: v.replace("age <= 31", "age <= 41") for k, v in FOLLOW.items()},
    "l_cand": """SELECT *, row_number() OVER (PARTITION BY date ORDER BY turnover DESC, instrument_id) AS rank FROM
        (SELECT b.date, c.prev_date, c.next_date, c.idx, b.instrument_id, b.open, b.close, b.volume, (b.close - p.close) / p.close * 100 AS change_pct, b.close * b.volume / 1e5 AS turnover
         FROM d_bars b JOIN d_cal c ON b.date = c.date JOIN d_bars p ON p.instrument_id = b.instrument_id AND p.date = c.prev_date
         WHERE p.close > 0 AND b.volume > 0 AND (b.close - p.close) / p.close * 100 >= 9) QUALIFY rank <= 15""",
    "l_today": "SELECT * FROM l_cand WHERE date = (SELECT max(date) FROM d_cal)",
    "l_buy": """SELECT t.instrument_id, t.broker, t.net, t.rk, CAST(round_even(t.net, 0) AS BIGINT) AS lots, coalesce(flip_rate >= 25, false) AS mk, r.hits IS NOT NULL AS own, flip_rate
        FROM b_top t JOIN l_today l ON l.instrument_id = t.instrument_id AND l.date = t.date LEFT JOIN b_profile USING (broker)
        LEFT JOIN b_regulars r ON r.instrument_id = t.instrument_id AND r.broker = t.broker""",
    "l_lists": """SELECT instrument_id, list(concat(broker, '+', lots, ' ', CAST(floor(flip_rate) AS BIGINT), '%') ORDER BY rk) FILTER (WHERE mk) AS ml,
            list(concat(broker, '+', lots) ORDER BY rk) FILTER (WHERE own) AS ol,
            CAST(sum(lots) FILTER (WHERE mk OR own) AS BIGINT) AS bl, string_agg(concat(broker, '+', lots), '、' ORDER BY rk) FILTER (WHERE mk OR own) AS bd
        FROM l_buy GROUP BY instrument_id""",
    "l_screen": """SELECT l.date, l.instrument_id, CAST(l.rank AS INTEGER) AS rank, instrument_name, type AS market, industry, l.close, l.change_pct, l.turnover, dt_vol / l.volume * 100 AS day_trade_pct,
            p.main_net AS main_net_prev, t.main_net AS main_net_today, f.flip_pressure_pct,
            CASE WHEN t.main_net > 0 THEN e.expected_lots END AS expected_lots, CASE WHEN t.main_net > 0 THEN e.expected_pct END AS expected_pct,
            CASE WHEN t.main_net > 0 THEN array_to_string(ml[1:2], '、') || CASE WHEN len(ml) > 2 THEN concat(' +', len(ml) - 2) ELSE '' END END AS market_blacklist,
            CASE WHEN t.main_net > 0 THEN array_to_string(ol[1:2], '、') || CASE WHEN len(ol) > 2 THEN concat(' +', len(ol) - 2) ELSE '' END END AS own_blacklist,
            CASE WHEN t.main_net > 0 THEN bl END AS blacklist_lots, CASE WHEN t.main_net > 0 THEN bd END AS blacklist_detail
        FROM l_today l LEFT JOIN d_info USING (instrument_id) LEFT JOIN d_daytrade d ON d.instrument_id = l.instrument_id AND d.date = l.date
        LEFT JOIN b_main p ON p.instrument_id = l.instrument_id AND p.date = l.prev_date LEFT JOIN b_main t ON t.instrument_id = l.instrument_id AND t.date = l.date
        LEFT JOIN b_flip f ON f.instrument_id = l.instrument_id AND f.date = l.date LEFT JOIN b_expected e ON e.instrument_id = l.instrument_id AND e.date = l.date
        LEFT JOIN l_lists s ON s.instrument_id = l.instrument_id""",
}


def lock(m: MarketTables, calendar: DataFrame | None = None) -> DataFrame:
    profile = None if calendar else m.broker_profile(LOCK_B)
    return report.lock_screen(m.bars, m.instruments, m.day_trade, m.broker_net, calendar or m.calendar, LOCK_P, LOCK_B, profile)


@query(
    "limit_up_lock_screen",
    """SELECT * REPLACE (round(change_pct, 6) AS change_pct, round(day_trade_pct, 6) AS day_trade_pct, round(flip_pressure_pct, 6) AS flip_pressure_pct,
          round(expected_lots, 6) AS expected_lots, round(expected_pct, 6) AS expected_pct) FROM l_screen""", **LOCK,
)
def lock_screen(m: MarketTables) -> DataFrame:
    return rounded(lock(m), "change_pct", "day_trade_pct", "flip_pressure_pct", "expected_lots", "expected_pct")


def lock_picks(m: MarketTables) -> DataFrame:
    """The lock candidates of the date before the newest, recorded with who bought what and the pressure planned for the next date."""
    day = m.calendar.filter("age = 2").select("date")
    newest = m.calendar.agg(F.max("date").alias("d")).select("d").scalar()
    cands = cut_lineage(screens.limit_up_candidates(m.bars, m.calendar, LOCK_P, every_date=True).join(day, "date", "left_semi"), "lock-picks")
    mine = cut_lineage(m.broker_net.join(cands.select("instrument_id", "date"), ["instrument_id", "date"], "left_semi"), "lock-nets")
    entry = F.concat("broker", F.lit("+"), F.bround("net").cast("long").cast("string"))
    detail = brokers.top_buyers(mine, TOP).groupBy("instrument_id").agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))).alias("es")).select(
        "instrument_id", F.array_join(F.transform("es", lambda x: x.e), "、").alias("detail")
    )
    main = brokers.broker_main_net(mine, TOP).select("instrument_id", "main_net")
    profile = cut_lineage(brokers.broker_profile(m.broker_net, m.calendar, LOCK_B, before=newest), "profile")
    planned = brokers.expected_pressure(mine, profile, m.bars, LOCK_B).select("instrument_id", "expected_pct")
    return cands.join(detail, "instrument_id", "left").join(main, "instrument_id", "left").join(planned, "instrument_id", "left").select(
        "date", "rank", "instrument_id", "main_net", "expected_pct", "detail"
    )


FOLLOW_UP = {
    **LOCK,
    "u_ref": "SELECT date AS ref, next_date AS td FROM d_cal WHERE age = 2",
    "u_picks": "SELECT l.instrument_id, l.rank, main_net FROM l_cand l JOIN u_ref ON l.date = ref LEFT JOIN b_main m ON m.instrument_id = l.instrument_id AND m.date = l.date",
    "u_profile": LOCK["b_profile"].replace("FROM b_follow GROUP", "FROM b_follow WHERE sell_date < (SELECT max(date) FROM d_cal) GROUP"),
    "u_plan": LOCK["b_expected"].replace("b_profile", "u_profile"),
    "u_real": """SELECT b.instrument_id, sum(CASE WHEN a.net < 0 THEN least(b.net, -a.net) ELSE 0e0 END) AS overlap, sum(CAST(round_even(b.net, 0) AS BIGINT)) AS bought,
            CAST(sum(CASE WHEN a.net < 0 THEN round_even(-a.net, 0) ELSE 0e0 END) AS BIGINT) AS sold
        FROM b_top b JOIN u_ref ON b.date = ref LEFT JOIN d_broker a ON a.instrument_id = b.instrument_id AND a.broker = b.broker AND a.date = td GROUP BY b.instrument_id""",
    "u_rows": """SELECT CAST(p.rank AS INTEGER) AS rank, p.instrument_id, ref AS ref_date, td AS trade_date, p.main_net AS locked_net, x.expected_pct,
            overlap / c.volume * 100 AS realised_pct, t.main_net AS main_net_today, CAST(bought AS BIGINT) AS blacklist_bought, sold AS blacklist_sold, sold / bought * 100 AS sold_pct,
            (c.close - r.close) / r.close * 100 AS change_pct, (c.open - r.close) / r.close * 100 AS gap_pct, (c.close - c.open) / c.open * 100 AS intraday_pct,
            (c.close - c.high) / c.high * 100 AS fade_pct, (c.high - c.low) / r.close * 100 AS amplitude_pct, CASE WHEN n >= 5 THEN c.volume / usual END AS volume_ratio,
            dt_vol / c.volume * 100 AS day_trade_pct
        FROM u_picks p CROSS JOIN u_ref JOIN d_bars c ON c.instrument_id = p.instrument_id AND c.date = td JOIN d_bars r ON r.instrument_id = p.instrument_id AND r.date = ref
        LEFT JOIN u_real u ON u.instrument_id = p.instrument_id LEFT JOIN b_main t ON t.instrument_id = p.instrument_id AND t.date = td
        LEFT JOIN d_daytrade d ON d.instrument_id = p.instrument_id AND d.date = td LEFT JOIN u_plan x ON x.instrument_id = p.instrument_id AND x.date = ref
        LEFT JOIN (SELECT instrument_id, avg(volume) AS usual, count(*) AS n FROM (SELECT b.*, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k
              FROM d_bars b JOIN u_ref ON b.date < td) WHERE k <= 20 GROUP BY instrument_id) v ON v.instrument_id = p.instrument_id""",
}
UP_COLS = ("expected_pct", "realised_pct", "sold_pct", "change_pct", "gap_pct", "intraday_pct", "fade_pct", "amplitude_pct", "volume_ratio", "day_trade_pct")


def lock_rows(m: MarketTables) -> DataFrame:
    return report.lock_follow_up(lock_picks(m), m.bars, m.day_trade, m.broker_net, m.calendar, TOP)


@query(
    "lock_follow_up", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in UP_COLS)}) FROM u_rows", **FOLLOW_UP,
)
def lock_follow_up(m: MarketTables) -> DataFrame:
    return rounded(lock_rows(m), *UP_COLS)


@query(
    "lock_stats",
    "SELECT round(avg(gap_pct), 6) AS gap_pct, round(avg(intraday_pct), 6) AS intraday_pct, count(*) FILTER (WHERE intraday_pct < 0) AS faded, count(*) AS n FROM u_rows",
    **FOLLOW_UP,
)
def lock_stats(m: MarketTables) -> DataFrame:
    return rounded(report.lock_stats(lock_rows(m)), "gap_pct", "intraday_pct")


# ---- picks ---------------------------------------------------------------

PICKS = {
    **RS,
    "p_picks": """SELECT 'strength' AS track, date, instrument_id, CAST(row_number() OVER (PARTITION BY date ORDER BY round(ret - med, 9) DESC, instrument_id) AS INTEGER) AS rank
        FROM rs_returns JOIN rs_median USING (date) WHERE ret BETWEEN 0 AND 0.3 QUALIFY rank <= 15""",
    "p_prior": "SELECT * FROM p_picks WHERE date = (SELECT max(date) FROM p_picks WHERE date < (SELECT max(date) FROM d_cal))",
}


def picks(m: MarketTables) -> DataFrame:
    sig = signals.relative_strength_signals(m.bars)
    return report.save_picks(sig.select(F.lit("strength").alias("track"), "date", "instrument_id", F.round("score", 9).alias("score")))


@query("recorded_picks", "SELECT * FROM p_picks", **PICKS)
def recorded_picks(m: MarketTables) -> DataFrame:
    """Picks stored by day; the newest day is stored wrongly first and then replaced."""
    path = shared_folder(m.spark, "picks")
    right = cut_lineage(picks(m), "picks")
    newest = right.agg(F.max("date").alias("d")).select("d").scalar()
    tables.record_day(path, right.withColumn("rank", F.when(F.col("date") == newest, F.lit(-1)).otherwise(F.col("rank"))))
    tables.record_day(path, right.filter(F.col("date") == newest))
    return tables.read_table(m.spark, path, "track", "date", "instrument_id", "rank")


@query("save_picks", "SELECT date, track, rank, instrument_id FROM p_picks", **PICKS)
def save_picks(m: MarketTables) -> DataFrame:
    return picks(m)


def moves(m: MarketTables) -> DataFrame:
    newest = m.calendar.agg(F.max("date").alias("d")).select("d").scalar()
    return report.follow_through(picks(m), attribution(m), newest)


@query(
    "follow_through",
    "SELECT p.date, track, rank, instrument_id, round(change_pct, 6) AS change_pct, one_line FROM p_prior p JOIN attr USING (instrument_id)", **PICKS, attr=ATTR,
)
def follow_through(m: MarketTables) -> DataFrame:
    return rounded(moves(m), "change_pct")


@query(
    "follow_stats",
    """SELECT track, round(avg(change_pct), 6) AS avg_change_pct, count(*) FILTER (WHERE change_pct > 0) AS up, count(*) AS n FROM p_prior JOIN attr USING (instrument_id)
       WHERE change_pct IS NOT NULL GROUP BY track""", **PICKS, attr=ATTR,
)
def follow_stats(m: MarketTables) -> DataFrame:
    return rounded(report.follow_stats(moves(m)), "avg_change_pct")


@query(
    "main_force_branches",
    """SELECT f.instrument_id, round(score, 6) AS score, main_buy, main_sell, main_net
       FROM mf f LEFT JOIN (SELECT b.* FROM b_main b JOIN (SELECT instrument_id FROM mf ORDER BY score DESC, instrument_id LIMIT 10) USING (instrument_id)
                            WHERE date = (SELECT max(date) FROM d_cal)) USING (instrument_id)""",
    **ps.MAIN_FORCE, **FOLLOW,
)
def main_force_branches(m: MarketTables) -> DataFrame:
    out = report.main_force_branches(ps._force(m), m.broker_net, m.calendar, top=TOP)
    return rounded(out.select("instrument_id", "score", "main_buy", "main_sell", "main_net"), "score")


@query(
    "data_health",
    """SELECT date, n, lag(n) OVER (ORDER BY date) AS prev_n, n < lag(n) OVER (ORDER BY date) * 0.7 AS incomplete
       FROM (SELECT date, count(*) AS n FROM d_bars GROUP BY date)""",
)
def data_health(m: MarketTables) -> DataFrame:
    return report.data_health(m.bars)


# ---- events --------------------------------------------------------------

RESTRICT = """SELECT instrument_id, CASE WHEN restricted AND start_date > DATE '2001-06-04' THEN concat('restricted from ', strftime(start_date, '%m-%d'), ' until ', strftime(end_date, '%m-%d'))
        WHEN restricted THEN concat('restricted until ', strftime(end_date, '%m-%d')) ELSE 'attention' END AS restriction
    FROM (SELECT coalesce(r.instrument_id, a.instrument_id) AS instrument_id, r.instrument_id IS NOT NULL AS restricted, start_date, end_date FROM
      (SELECT * FROM (SELECT CAST(code AS BIGINT) AS instrument_id, start_date, end_date, row_number() OVER (PARTITION BY code ORDER BY end_date DESC, start_date DESC) AS k
          FROM d_notices WHERE kind = 'restricted') WHERE k = 1 AND end_date >= DATE '2001-06-04') r
      FULL JOIN (SELECT DISTINCT CAST(code AS BIGINT) AS instrument_id FROM d_notices WHERE kind = 'attention') a ON a.instrument_id = r.instrument_id)"""


@query("restriction_labels", "SELECT * FROM restrict_labels", restrict_labels=RESTRICT)
def restriction_labels(m: MarketTables) -> DataFrame:
    return events.restriction_labels(normalize.normalize_notices(m.restriction_notices), "2001-06-04")


EXDIV = """SELECT instrument_id, date, concat('ex ', CASE WHEN cash > 0 AND share_dividend > 0 THEN 'cash and shares' WHEN share_dividend > 0 THEN 'shares' ELSE 'cash' END, ' ',
      CASE WHEN date = DATE '1995-01-20' THEN 'today' ELSE strftime(date, '%m-%d') END,
      CASE WHEN cash > 0 THEN concat(' (', CAST(cash AS BIGINT), ')') WHEN share_dividend > 0 THEN concat(' (', CAST(share_dividend AS BIGINT), ')') ELSE '' END) AS ex_dividend
    FROM (SELECT instrument_id, date, coalesce(cash, 0) AS cash, coalesce(share_dividend, 0) AS share_dividend,
            row_number() OVER (PARTITION BY instrument_id ORDER BY date, coalesce(cash, 0), coalesce(share_dividend, 0)) AS k FROM d_exdiv)
    WHERE k = 1 AND date BETWEEN DATE '1995-01-20' AND DATE '1995-01-20' + INTERVAL 45 DAY"""


@query("dividend_labels", "SELECT * FROM exdiv_labels", exdiv_labels=EXDIV)
def dividend_labels(m: MarketTables) -> DataFrame:
    return events.dividend_labels(normalize.normalize_dividend_notices(m.dividend_notices), "1995-01-20")


@query(
    "normalize_notices",
    "SELECT CAST(code AS BIGINT) AS instrument_id, start_date, end_date, kind FROM d_notices",
)
def normalize_notices(m: MarketTables) -> DataFrame:
    return normalize.normalize_notices(m.restriction_notices)


# ---- daily report --------------------------------------------------------

REPORT = {
    **ps.MAIN_FORCE, **FOLLOW, **RS,
    "tech": ps.TECH, "chip": ps.CHIP, "share": ps.SHARE, "risk": ps.RISK, "restrict_labels": RESTRICT,
    "r_cand": """SELECT 'day trade' AS track, instrument_id FROM (SELECT instrument_id, count(*) AS n, avg(volume) AS av, avg(amp) AS aa
          FROM (SELECT *, (high - low) / lag(close) OVER (PARTITION BY instrument_id ORDER BY date) * 100 AS amp FROM d_bars WHERE date IN (SELECT date FROM d_cal WHERE age <= 20)) GROUP BY instrument_id)
          JOIN d_info USING (instrument_id) WHERE n >= 10 AND aa >= 4.5 AND av >= CASE WHEN type = 'tpex' THEN 25 ELSE 20 END
        UNION ALL SELECT 'main force', instrument_id FROM mf
        UNION ALL SELECT 'strength', instrument_id FROM (SELECT instrument_id, (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) AS ret, avg(volume) AS av
          FROM d_bars WHERE date IN (SELECT date FROM d_cal WHERE age <= 10) GROUP BY instrument_id HAVING count(*) >= 9) JOIN d_info USING (instrument_id)
          WHERE ret BETWEEN 0 AND 3 AND av >= CASE WHEN type = 'tpex' THEN 30 ELSE 20 END""",
    "r_flow10": ps.flow_window_sql(10), "r_flow20": ps.flow_window_sql(20),
    "r_today": """SELECT c.instrument_id, c.close AS close_today, (c.close - p.close) / p.close * 100 AS change_today_pct, c.foreign_net, c.trust_net, c.dealer_net, c.dt_vol / c.volume * 100 AS day_trade_pct
        FROM (SELECT * FROM d_panel WHERE date = (SELECT max(date) FROM d_cal)) c LEFT JOIN (SELECT * FROM d_panel WHERE date = (SELECT date FROM d_cal WHERE age = 2)) p USING (instrument_id)""",
    "r_sbl": """SELECT instrument_id, arg_max(sbl_balance, date) AS sbl_balance, max(date) AS sbl_date FROM d_sbl GROUP BY instrument_id""",
}


def report_candidates(m: MarketTables) -> DataFrame:
    parts = {
        "day trade": ps._candidates(m), "main force": ps._force(m),
        "strength": screens.relative_strength_screen(m.bars, m.instruments, m.days, ps.SCREEN_RS),
    }
    out = None
    for track, df in parts.items():
        part = df.select(F.lit(track).alias("track"), "instrument_id")
        out = part if out is None else out.unionByName(part)
    return out


SHOWN = {
    "t": ("close_today", "change_today_pct", "day_trade_pct"), "a": ("foreign_net_10", "trust_net_10", "margin_change_10"), "b": ("foreign_net_20", "trust_net_20", "margin_change_20"),
    "n": ("foreign_net_today", "margin_change_today"), "p": ("foreign_net_prior", "trust_net_prior", "margin_change_prior"),
    "chip": ("foreign_streak", "trust_streak", "dealer_streak", "dominance_pct", "volume_ratio", "short_margin_pct"),
    "tech": ("ma_align", "long_term", "half_year", "bias20_pct", "year_position_pct"), "h": ("day_trade_mean_pct", "day_trade_heat"), "s": ("sbl_balance",),
    "share": ("market_value",), "risk": ("stop", "stop_pct", "target"), "restrict_labels": ("restriction",), "x": ("ex_dividend",),
    "k": ("main_net", "flip_pressure_pct"), "e": ("expected_pct",), "d_info": ("industry",),
}
MEASURES = (
    "change_today_pct", "day_trade_pct", "dominance_pct", "volume_ratio", "short_margin_pct", "bias20_pct", "year_position_pct", "day_trade_mean_pct",
    "market_value", "stop", "stop_pct", "target", "flip_pressure_pct", "expected_pct", "margin_change_10", "margin_change_20", "margin_change_today", "margin_change_prior",
)


def shown_sql() -> str:
    return ", ".join(f"round({t}.{c}, 6) AS {c}" if c in MEASURES else f"{t}.{c}" for t, columns in SHOWN.items() for c in columns)


def window_sql(n: int) -> str:
    return f"SELECT instrument_id, foreign_net AS foreign_net_{n}, trust_net AS trust_net_{n}, margin_change AS margin_change_{n} FROM r_flow{n}"


@query(
    "daily_report_table",
    f"""SELECT track, c.instrument_id, {shown_sql()}, verdict_votes, {LABEL.format(v='verdict_votes')} AS verdict
        FROM (SELECT c.track, c.instrument_id, {VERDICT} AS verdict_votes FROM r_cand c LEFT JOIN tech USING (instrument_id) LEFT JOIN chip USING (instrument_id)) c
        LEFT JOIN tech USING (instrument_id) LEFT JOIN chip USING (instrument_id) LEFT JOIN r_today t USING (instrument_id)
        LEFT JOIN ({window_sql(10)}) a USING (instrument_id) LEFT JOIN ({window_sql(20)}) b USING (instrument_id)
        LEFT JOIN r_now n USING (instrument_id) LEFT JOIN r_prior p USING (instrument_id) LEFT JOIN r_trend h USING (instrument_id)
        LEFT JOIN (SELECT s.* FROM r_sbl s JOIN d_cal ON date = sbl_date WHERE age <= 6) s USING (instrument_id) LEFT JOIN share USING (instrument_id)
        LEFT JOIN (SELECT *, (stop - close) / close * 100 AS stop_pct, close + (close - stop) * 2 AS target FROM risk) risk USING (instrument_id)
        LEFT JOIN restrict_labels USING (instrument_id) LEFT JOIN r_ex x USING (instrument_id)
        LEFT JOIN (SELECT m.instrument_id, main_net, flip_pressure_pct FROM b_main m LEFT JOIN b_flip f USING (instrument_id, date)
           WHERE date = (SELECT max(date) FROM d_cal)) k USING (instrument_id)
        LEFT JOIN (SELECT instrument_id, expected_pct FROM b_expected WHERE date = (SELECT max(date) FROM d_cal)) e USING (instrument_id) LEFT JOIN d_info USING (instrument_id)""",
    r_prior=ps.DAY_PRIOR, r_now=ps.DAY_PRIOR.replace("age = 3", "age = 2").replace("(SELECT date FROM d_cal WHERE age = 2)) c", "(SELECT date FROM d_cal WHERE age = 1)) c").replace("_prior", "_today"),
    r_trend=ps.DAY_TREND, r_ex=EXDIV, **REPORT,
)
def daily_report(m: MarketTables) -> DataFrame:
    cal, days = m.calendar, m.days
    own = {"flow_days": days, "balance_days": days}
    recent = on_last_dates(m.broker_net, days, 2)
    today = recent.filter(F.col("date") == days.newest())
    broker = brokers.broker_timeline(recent, on_last_dates(m.bars, days, 2), cal, TOP).filter(F.col("date") == days.newest()).drop("date")
    expected = brokers.expected_pressure(today, pb.stored_profile(m), on_last_dates(m.bars, days, 1), pb.P).select("instrument_id", "expected_pct")
    parts = [
        flows.today_price(m.bars, days),
        flows.flow_windows(m.institutional, m.margin, 10, "_10", **own), flows.flow_windows(m.institutional, m.margin, 20, "_20", **own),
        flows.day_flows(m.institutional, m.margin, 0, "_today", **own), flows.day_flows(m.institutional, m.margin, 1, "_prior", **own),
        flows.chip_signals(m.institutional, m.bars, m.margin, days, **own), technical.tech_signals(m.bars),
        flows.day_trade_ratio(m.day_trade, m.bars, days), flows.day_trade_trend(m.day_trade, m.bars),
        flows.sbl_latest(m.sbl, cal), flows.share_stats(m.shareholding, m.bars, days),
        technical.risk_levels(m.bars), events.restriction_labels(normalize.normalize_notices(m.restriction_notices), "2001-06-04"),
        events.dividend_labels(normalize.normalize_dividend_notices(m.dividend_notices), "1995-01-20").drop("date"),
        broker, expected, m.instruments,
    ]
    columns = [c for own in SHOWN.values() for c in own]
    out = report.daily_report(report_candidates(m), parts).select("track", "instrument_id", *columns, "verdict_votes", "verdict")
    return rounded(out, *MEASURES)


