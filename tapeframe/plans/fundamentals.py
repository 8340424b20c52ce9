"""Fundamental queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Value
from ..operators import fundamentals as fund
from ..operators import joins, landmines, screens
from ..sources.landing import MarketTables
from .registry import query, rounded

F_TABLES = {
    "f_summary": """SELECT instrument_id, arg_max(ym, m) AS revenue_month, arg_max(yoy, m) AS last_yoy, avg(yoy) AS mean3_yoy FROM
        (SELECT instrument_id, year * 12 + month AS m, strftime(make_date(year, month, 1), '%Y/%m') AS ym, (revenue - prior) / prior * 100 AS yoy,
                row_number() OVER (PARTITION BY instrument_id ORDER BY year DESC, month DESC) AS rn FROM d_revcum WHERE prior > 0) WHERE rn <= 3 GROUP BY instrument_id""",
    "f_profit": """SELECT instrument_id, date, gross_profit * 100 / revenue AS gross_margin, operating_income * 100 / revenue AS operating_margin,
        net_income * 100 / revenue AS net_margin, eps,
        CASE WHEN lag(eps, 4) OVER w <> 0 THEN (eps - lag(eps, 4) OVER w) * 100 / abs(lag(eps, 4) OVER w) END AS eps_yoy
        FROM d_wide WINDOW w AS (PARTITION BY instrument_id ORDER BY date)""",
    "f_health": """SELECT instrument_id, date, CASE WHEN n4 = 4 THEN ttm / equity * 100 END AS roe, liabilities / total_assets * 100 AS debt_ratio,
        current_assets / current_liabilities * 100 AS current_ratio, equity * 10 / share_capital AS book_value, ocf AS operating_cash,
        CASE WHEN net_income <> 0 THEN ocf / net_income * 100 END AS cash_quality, ocf + capex AS free_cash FROM
        (SELECT *, sum(net_income) OVER f AS ttm, count(net_income) OVER f AS n4,
            CASE WHEN month(date) <= 3 THEN operating_cash_flow ELSE operating_cash_flow - lag(operating_cash_flow) OVER y END AS ocf,
            CASE WHEN month(date) <= 3 THEN capital_expenditure ELSE capital_expenditure - lag(capital_expenditure) OVER y END AS capex
         FROM d_wide WINDOW f AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
                            y AS (PARTITION BY instrument_id, year(date) ORDER BY date))""",
    "f_rates": """SELECT instrument_id, CASE WHEN n < 2 THEN '-' WHEN u = 3 THEN 'all up' WHEN u = 0 THEN 'all down' ELSE concat(u, ' up ', 3 - u, ' down') END AS three_rates FROM
        (SELECT instrument_id, count(*) AS n,
           (max(g) FILTER (WHERE k = 1) > max(g) FILTER (WHERE k = 2))::INT + (max(o) FILTER (WHERE k = 1) > max(o) FILTER (WHERE k = 2))::INT
           + (max(t) FILTER (WHERE k = 1) > max(t) FILTER (WHERE k = 2))::INT AS u
         FROM (SELECT instrument_id, round(gross_margin, 1) AS g, round(operating_margin, 1) AS o, round(net_margin, 1) AS t,
                 row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM f_profit) WHERE k <= 2 GROUP BY instrument_id)""",
    "f_eps": """SELECT instrument_id, ttm AS eps_ttm, CASE WHEN n >= 8 AND before <> 0 THEN (ttm - before) * 100 / abs(before) END AS eps_growth FROM
        (SELECT instrument_id, count(*) AS n, sum(eps) FILTER (WHERE k <= 4) AS ttm, sum(eps) FILTER (WHERE k > 4) AS before
         FROM (SELECT instrument_id, eps, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM d_wide) WHERE k <= 8 GROUP BY instrument_id) WHERE n >= 4""",
    "f_divyears": """SELECT instrument_id, CAST(regexp_extract(year, '^\\s*(\\d+)', 1) AS INTEGER) + 1911 AS year, sum(cash) AS cash, sum(share_dividend) AS share_dividend
        FROM d_div GROUP BY ALL""",
    "f_streak": """SELECT instrument_id, CAST(coalesce(min(CASE WHEN cash <= 0 THEN k END), max(k) + 1) - 1 AS BIGINT) AS dividend_years
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY year DESC) AS k FROM f_divyears) GROUP BY instrument_id""",
    "f_val": """SELECT instrument_id, arg_max(per, date) AS per, arg_max(pbr, date) AS pbr, arg_max("yield", date) AS "yield" FROM d_val GROUP BY instrument_id""",
    "f_lead": """SELECT industry, instrument_id AS peer_id, instrument_name AS peer_name, row_number() OVER (PARTITION BY industry ORDER BY close * volume DESC, instrument_id) AS k
        FROM d_info JOIN d_bars USING (instrument_id) WHERE date = (SELECT max(date) FROM d_cal) AND volume > 0""",
    "f_peers": """SELECT * FROM (SELECT instrument_id, industry, row_number() OVER (PARTITION BY instrument_id ORDER BY k) AS rank, peer_id, peer_name
        FROM d_info JOIN f_lead USING (industry) WHERE peer_id <> instrument_id) WHERE rank <= 5""",
    "f_q": """SELECT *, gross_profit * 100 / revenue AS gm FROM d_wide""",
    "f_chart": """SELECT o.instrument_id, close, CASE WHEN n >= 60 THEN mean END AS ma_long,
          CASE WHEN least(20, n - 1) >= 5 AND base > 0 THEN (close - base) / base * 100 - (SELECT median(ret) FROM f_market) END AS vs_market_pct,
          streak, margin_growth, holder_pct, holder_change
        FROM (SELECT instrument_id, arg_max(close, date) AS close, count(*) AS n, avg(close) AS mean, arg_min(close, date) FILTER (WHERE k <= 21) AS base
              FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM d_bars) WHERE k <= 60 GROUP BY instrument_id) o
        LEFT JOIN f_sell USING (instrument_id)
        LEFT JOIN (SELECT instrument_id, CASE WHEN count(*) >= 2 AND arg_min(margin_balance, date) > 0
             THEN (arg_max(margin_balance, date) - arg_min(margin_balance, date)) / arg_min(margin_balance, date) END AS margin_growth FROM d_margin GROUP BY instrument_id) USING (instrument_id)
        LEFT JOIN (SELECT instrument_id, arg_max(pct_1000, date) AS holder_pct,
               CASE WHEN count(*) = 2 THEN round(arg_max(pct_1000, date) - arg_min(pct_1000, date), 2) END AS holder_change
             FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM d_hold) WHERE k <= 2 GROUP BY instrument_id) USING (instrument_id)""",
    "f_market": """SELECT (arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100 AS ret FROM d_bars
        WHERE date IN (SELECT date FROM d_cal WHERE age <= 21) GROUP BY instrument_id HAVING count(*) >= 2 AND arg_min(close, date) > 0""",
    "f_sell": """SELECT instrument_id, -(coalesce(min(CASE WHEN inst_net >= 0 THEN k END), max(k) + 1) - 1) AS streak
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS k FROM d_flow) GROUP BY instrument_id""",
    "f_lm": """SELECT i.instrument_id, close, vs_market_pct, holder_pct, last_yoy, mean3_yoy, eps_ttm, eps_growth, a.gm AS gross_margin,
          list_filter([CASE WHEN close < ma_long THEN 'below ma60' END, CASE WHEN vs_market_pct <= -10 THEN 'weak vs market' END,
            CASE WHEN streak <= -4 THEN 'institutions selling' END, CASE WHEN margin_growth >= 0.2 THEN 'margin surge' END,
            CASE WHEN holder_change <= -1 THEN 'big holders leaving' END], lambda x: x IS NOT NULL) AS chart,
          list_filter([CASE WHEN mean3_yoy <= -20 THEN 'revenue slump' END, CASE WHEN last_yoy <= -30 THEN 'revenue crash' END,
            CASE WHEN n_eps >= 8 AND eps_growth <= -50 THEN 'earnings collapse' END, CASE WHEN n_eps >= 8 AND eps_ttm < 0 THEN 'four-quarter loss' END,
            CASE WHEN a.net_income < 0 THEN 'quarter loss' END, CASE WHEN b.gm - a.gm >= 5 THEN 'margin erosion' END], lambda x: x IS NOT NULL) AS fund
        FROM d_info i LEFT JOIN f_chart USING (instrument_id)
        LEFT JOIN (SELECT instrument_id, max(date) AS date, count(eps) AS n_eps FROM d_wide GROUP BY instrument_id) m ON m.instrument_id = i.instrument_id
        LEFT JOIN f_q a ON a.instrument_id = m.instrument_id AND a.date = m.date
        LEFT JOIN f_q b ON b.instrument_id = m.instrument_id AND year(b.date) = year(m.date) - 1 AND month(b.date) = month(m.date)
        LEFT JOIN f_summary s ON s.instrument_id = i.instrument_id LEFT JOIN f_eps e ON e.instrument_id = i.instrument_id""",
}


@query("revenue_yoy_panel", "SELECT * FROM d_revp")
def revenue_yoy_panel(m: MarketTables) -> DataFrame:
    return m.revenue_panel


@query(
    "monthly_revenue",
    """SELECT a.instrument_id, a.year, a.month, a.revenue, round((a.revenue - prior) * 100 / prior, 6) AS yoy,
         round((a.revenue - b.revenue) * 100 / b.revenue, 6) AS mom, round((cum - cum_prior) * 100 / cum_prior, 6) AS cum_yoy
       FROM d_revcum a LEFT JOIN d_rev b ON b.instrument_id = a.instrument_id AND b.year * 12 + b.month = a.year * 12 + a.month - 1""",
)
def monthly_revenue(m: MarketTables) -> DataFrame:
    return rounded(fund.monthly_revenue(m.revenue), "yoy", "mom", "cum_yoy")


@query(
    "previous_year_lookup",
    "SELECT instrument_id, year, month, revenue, prior FROM d_revcum",
)
def previous_year(m: MarketTables) -> DataFrame:
    return joins.previous_year(m.revenue, "revenue", "prior")


@query("revenue_summary", "SELECT instrument_id, revenue_month, round(last_yoy, 6) AS last_yoy, round(mean3_yoy, 6) AS mean3_yoy FROM f_summary", **F_TABLES)
def revenue_summary(m: MarketTables) -> DataFrame:
    return rounded(fund.revenue_summary(m.revenue), "last_yoy", "mean3_yoy")


@query("statements_pivot", "SELECT * FROM d_wide", **F_TABLES)
def pivot(m: MarketTables) -> DataFrame:
    return joins.wide(m.statements, (*fund.INCOME_ITEMS, *fund.BALANCE_ITEMS, *fund.CASH_ITEMS))


@query(
    "profitability",
    """SELECT instrument_id, date, round(gross_margin, 6) AS gross_margin, round(operating_margin, 6) AS operating_margin, round(net_margin, 6) AS net_margin,
        eps, round(eps_yoy, 6) AS eps_yoy FROM f_profit""", **F_TABLES,
)
def profitability(m: MarketTables) -> DataFrame:
    return rounded(fund.profitability(m.statements), "gross_margin", "operating_margin", "net_margin", "eps_yoy")


@query(
    "financial_health",
    """SELECT instrument_id, date, round(roe, 6) AS roe, round(debt_ratio, 6) AS debt_ratio, round(current_ratio, 6) AS current_ratio,
        round(book_value, 6) AS book_value, round(operating_cash, 7) AS operating_cash, round(cash_quality, 6) AS cash_quality,
        round(free_cash, 7) AS free_cash FROM f_health""", **F_TABLES,
)
def financial_health(m: MarketTables) -> DataFrame:
    out = rounded(fund.financial_health(m.statements), "roe", "debt_ratio", "current_ratio", "book_value", "cash_quality")
    return rounded(out, "operating_cash", "free_cash", digits=7)


@query("three_rates_label", "SELECT * FROM f_rates", **F_TABLES)
def three_rates(m: MarketTables) -> DataFrame:
    return fund.three_rates_label(fund.profitability(m.statements))


@query("eps_ttm_growth", "SELECT instrument_id, round(eps_ttm, 8) AS eps_ttm, round(eps_growth, 6) AS eps_growth FROM f_eps", **F_TABLES)
def eps_growth(m: MarketTables) -> DataFrame:
    return rounded(rounded(fund.eps_ttm_growth(m.statements), "eps_growth"), "eps_ttm", digits=8)


@query(
    "valuation_position",
    """SELECT instrument_id, arg_max(per, date) AS per, arg_max(pbr, date) AS pbr, arg_max("yield", date) AS "yield",
          round(CASE WHEN count(*) >= 8 AND max(per) > min(per) THEN (arg_max(per, date) - min(per)) / (max(per) - min(per)) * 100 END, 6) AS per_position
       FROM d_val WHERE date >= (SELECT max(date) FROM d_val) - INTERVAL 400 DAY GROUP BY instrument_id""",
)
def valuation_position(m: MarketTables) -> DataFrame:
    return rounded(fund.valuation_position(m.valuation, min_values=8), "per_position")


@query("dividend_years", "SELECT * FROM f_divyears", **F_TABLES)
def dividend_years(m: MarketTables) -> DataFrame:
    return fund.dividend_years(m.dividends)


@query("dividend_streak", "SELECT * FROM f_streak", **F_TABLES)
def dividend_streak(m: MarketTables) -> DataFrame:
    return fund.dividend_streak(m.dividends)


NOTE = """concat_ws(', ', CASE WHEN last_yoy IS NULL THEN 'no revenue data' WHEN last_yoy >= 20 THEN concat('strong growth +', CAST(round_even(last_yoy, 0) AS BIGINT), '%')
    WHEN last_yoy >= 0 THEN concat('mild growth +', CAST(round_even(last_yoy, 0) AS BIGINT), '%') ELSE concat('shrinking ', CAST(round_even(last_yoy, 0) AS BIGINT), '%') END,
    CASE WHEN per <= 0 THEN 'loss or odd multiple' WHEN per > 40 THEN concat('expensive at ', CAST(round_even(per, 0) AS BIGINT))
         WHEN per IS NOT NULL THEN concat('multiple ', CAST(round_even(per, 0) AS BIGINT)) END)"""


@query(
    "fundamental_shortlist",
    f"""SELECT instrument_id, revenue_month, round(last_yoy, 6) AS last_yoy, round(mean3_yoy, 6) AS mean3_yoy, per, pbr, "yield", {NOTE} AS note
        FROM d_info LEFT JOIN f_summary USING (instrument_id) LEFT JOIN f_val USING (instrument_id)""", **F_TABLES,
)
def shortlist(m: MarketTables) -> DataFrame:
    return rounded(fund.fundamental_shortlist(m.instruments, m.revenue, m.valuation), "last_yoy", "mean3_yoy")


@query("industry_peers", "SELECT instrument_id, industry, CAST(rank AS INTEGER) AS rank, peer_id, peer_name FROM f_peers", **F_TABLES)
def industry_peers(m: MarketTables) -> DataFrame:
    return fund.industry_peers(m.bars, m.instruments)


@query(
    "peer_table",
    """SELECT p.instrument_id, CAST(rank AS INTEGER) AS rank, peer_id, peer_name, per, pbr, "yield", round(last_yoy, 6) AS last_yoy FROM
         (SELECT instrument_id, rank, peer_id, peer_name FROM f_peers UNION ALL
          SELECT DISTINCT p.instrument_id, 0, p.instrument_id, instrument_name FROM f_peers p JOIN d_info USING (instrument_id)) p
       LEFT JOIN f_val v ON v.instrument_id = peer_id LEFT JOIN f_summary s ON s.instrument_id = peer_id""", **F_TABLES,
)
def peer_table(m: MarketTables) -> DataFrame:
    peers = fund.industry_peers(m.bars, m.instruments)
    return rounded(fund.peer_table(peers, m.instruments, m.revenue, m.valuation), "last_yoy")


VALUE = Value(min_yield=4.5, max_per=27, min_dividend_years=1, min_roe=6.0, shortlist=15, max_lumpy=1, lumpy_industries=("NATION_1",))


@query(
    "value_screen",
    """SELECT instrument_id, instrument_name, industry, "yield", per, pbr, roe_est, round(last_yoy, 6) AS last_yoy, round(eps_ttm, 8) AS eps_ttm,
         round(eps_growth, 6) AS eps_growth, dividend_years, lumpy, round(score, 6) AS score
       FROM (SELECT *, row_number() OVER (PARTITION BY lumpy ORDER BY score DESC, instrument_id) AS k FROM (SELECT *,
          "yield" * 3 + 100 / greatest(per, 1) + roe_est * 1.5 + CASE WHEN lumpy THEN 0 ELSE greatest(least(coalesce(last_yoy, 0), 50), -30) * 0.4 END
            + greatest(least(coalesce(eps_growth, 0), 60), -30) * 0.3 + least(dividend_years, 20) * 1.5 AS score
        FROM (SELECT *, contains(industry, 'NATION_1') AS lumpy FROM (SELECT instrument_id, "yield", per, pbr, round(pbr / per * 100, 1) AS roe_est FROM f_val
               WHERE "yield" >= 4.5 AND per > 0 AND per <= 27 AND pbr > 0 AND pbr <= 3 AND pbr / per * 100 >= 6 ORDER BY "yield" / greatest(per, 1) DESC, instrument_id LIMIT 15)
             JOIN f_streak USING (instrument_id) LEFT JOIN f_summary USING (instrument_id) LEFT JOIN f_eps USING (instrument_id) JOIN d_info USING (instrument_id) WHERE dividend_years >= 1)))
       WHERE NOT lumpy OR k <= 1""", **F_TABLES,
)
def value_screen(m: MarketTables) -> DataFrame:
    out = screens.value_screen(
        fund.valuation_latest(m.valuation), fund.dividend_streak(m.dividends), fund.revenue_summary(m.revenue),
        fund.eps_ttm_growth(m.statements), m.instruments, VALUE,
    )
    return rounded(rounded(out, "last_yoy", "eps_growth", "score"), "eps_ttm", digits=8)


def landmine(m: MarketTables) -> DataFrame:
    return landmines.landmine_flags(
        m.instruments, m.bars, m.institutional, m.margin, m.big_holders, m.instruments, m.revenue, m.statements, m.calendar
    )


LM = """SELECT instrument_id, CAST(len(chart) + len(fund) AS INTEGER) AS risk_score,
    CASE WHEN len(chart) + len(fund) >= 6 THEN 'severe' WHEN len(chart) + len(fund) >= 4 THEN 'high' WHEN len(chart) + len(fund) >= 2 THEN 'mid' ELSE 'low' END AS risk_level,
    CAST(len(fund) AS INTEGER) AS n_fund_flags, coalesce(nullif(list_aggregate(list_concat(chart, fund), 'string_agg', '; '), ''), '-') AS red_flags,
    close, round(vs_market_pct, 6) AS vs_market_pct, holder_pct, round(last_yoy, 6) AS last_yoy, round(mean3_yoy, 6) AS mean3_yoy,
    round(eps_ttm, 8) AS eps_ttm, round(eps_growth, 6) AS eps_growth, round(gross_margin, 6) AS gross_margin FROM f_lm"""
LM_ROUND = ("vs_market_pct", "last_yoy", "mean3_yoy", "eps_growth", "gross_margin")


@query("landmine_flags", LM, **F_TABLES)
def landmine_flags(m: MarketTables) -> DataFrame:
    return rounded(rounded(landmine(m), *LM_ROUND), "eps_ttm", digits=8)


@query("landmine_at_least", f"SELECT * FROM ({LM}) WHERE risk_level IN ('high', 'severe')", **F_TABLES)
def landmine_floor(m: MarketTables) -> DataFrame:
    return rounded(rounded(landmines.at_least(landmine(m), "high"), *LM_ROUND), "eps_ttm", digits=8)


VOTE = """CASE three_rates WHEN 'all up' THEN 1 WHEN 'all down' THEN -1 ELSE 0 END
    + coalesce(CASE WHEN last_yoy > 15 THEN 1 WHEN last_yoy < -10 THEN -1 END, 0) + coalesce(CASE WHEN eps_growth > 15 THEN 1 WHEN eps_growth < -15 THEN -1 END, 0)
    + coalesce(CASE WHEN cash_quality >= 80 THEN 1 WHEN cash_quality < 40 THEN -1 END, 0) - CASE WHEN n_fund > 0 THEN 1 ELSE 0 END"""
F_VOTE = {
    "f_vote": f"""SELECT instrument_id, three_rates, last_yoy, eps_growth, cash_quality, CAST({VOTE} AS INTEGER) AS fund_votes
      FROM f_rates LEFT JOIN f_summary USING (instrument_id) LEFT JOIN f_eps USING (instrument_id)
      LEFT JOIN (SELECT instrument_id, arg_max(cash_quality, date) AS cash_quality FROM f_health WHERE cash_quality IS NOT NULL GROUP BY instrument_id) USING (instrument_id)
      LEFT JOIN (SELECT instrument_id, len(fund) AS n_fund FROM f_lm) USING (instrument_id)"""
}


def vote(m: MarketTables) -> DataFrame:
    return fund.fundamental_vote(
        fund.revenue_summary(m.revenue), fund.eps_ttm_growth(m.statements), fund.financial_health(m.statements),
        fund.three_rates_label(fund.profitability(m.statements)), landmine(m),
    )


@query(
    "fundamental_vote",
    "SELECT instrument_id, three_rates, round(last_yoy, 6) AS last_yoy, round(eps_growth, 6) AS eps_growth, round(cash_quality, 6) AS cash_quality, fund_votes FROM f_vote",
    **F_TABLES, **F_VOTE,
)
def fundamental_vote(m: MarketTables) -> DataFrame:
    return rounded(vote(m), "last_yoy", "eps_growth", "cash_quality")


@query("concentration_from_tiers", "SELECT date, instrument_id, pct_1000, pct_400 FROM d_hold")
def concentration(m: MarketTables) -> DataFrame:
    return m.big_holders


@query(
    "month_starts", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS date FROM d_cal GROUP BY 1",
)
def month_starts(m: MarketTables) -> DataFrame:
    from ..sources.calendar import month_starts as starts

    return starts(m.calendar)


