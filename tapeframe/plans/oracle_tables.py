"""The derived domain tables as SQL, for checking operators against another engine."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "d_trades": """
        SELECT l_suppkey AS instrument_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               CAST(CAST(l_shipdate AS DATE) - CAST(date_trunc('week', l_shipdate) AS DATE) AS BIGINT) AS dow,
               CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS tick,
               l_quantity AS qty,
               CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END AS signed,
               l_returnflag AS flag, l_linestatus AS status,
               CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS tax,
               CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS disc
        FROM lineitem""",
    "d_panel": """
        SELECT instrument_id, date,
               CAST(min(dow * 1000000000000 + tick) % 1000000000000 AS DOUBLE) / 100e0 AS open,
               CAST(max(tick) AS DOUBLE) / 100e0 AS high,
               CAST(min(tick) AS DOUBLE) / 100e0 AS low,
               CAST(max(dow * 1000000000000 + tick) % 1000000000000 AS DOUBLE) / 100e0 AS close,
               sum(qty) AS volume,
               sum(CASE WHEN flag = 'A' THEN signed ELSE 0e0 END) AS foreign_net,
               sum(CASE WHEN flag = 'R' THEN signed ELSE 0e0 END) AS trust_net,
               sum(CASE WHEN flag = 'N' THEN signed ELSE 0e0 END) AS dealer_net,
               sum(signed) AS total_net,
               sum(qty * (tax + 100)) / 100e0 AS margin_balance,
               sum(qty * disc) / 10e0 AS short_balance,
               sum(CASE WHEN status = 'O' THEN qty ELSE 0e0 END) AS dt_vol,
               sum(CASE WHEN flag = 'N' THEN qty ELSE 0e0 END) AS sbl_balance
        FROM d_trades GROUP BY instrument_id, date""",
    "d_bars": "SELECT instrument_id, date, open, high, low, close, volume FROM d_panel",
    "d_inst": "SELECT instrument_id, date, foreign_net, trust_net, dealer_net, total_net FROM d_panel",
    "d_margin": "SELECT instrument_id, date, margin_balance, short_balance FROM d_panel",
    "d_daytrade": "SELECT instrument_id, date, dt_vol FROM d_panel",
    "d_sbl": "SELECT instrument_id, date, sbl_balance FROM d_panel WHERE sbl_balance > 0",
    "d_cal": """
        SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS idx,
               CAST(row_number() OVER (ORDER BY date DESC) AS BIGINT) AS age,
               lag(date) OVER (ORDER BY date) AS prev_date,
               lead(date) OVER (ORDER BY date) AS next_date,
               CAST(count(*) OVER () AS BIGINT) AS n_dates
        FROM (SELECT DISTINCT date FROM d_panel)""",
    "d_info": """
        SELECT s_suppkey AS instrument_id, s_name AS instrument_name, n_name AS industry,
               CASE WHEN s_suppkey % 2 = 0 THEN 'tpex' ELSE 'twse' END AS type
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "d_flow": """
        SELECT p.instrument_id, p.date, open, high, low, close, volume,
               CASE WHEN type = 'tpex' THEN foreign_net ELSE trust_net END AS inst_net, margin_balance
        FROM d_panel p LEFT JOIN d_info USING (instrument_id)""",
    "d_broker": """
        SELECT l_suppkey AS instrument_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               c_mktsegment AS broker,
               sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) AS net
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        GROUP BY ALL""",
    "d_lines": """
        SELECT l_suppkey AS instrument_id, l_quantity AS qty, l_returnflag AS flag, l_linestatus AS status,
               CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents,
               CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS disc,
               CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)
                 * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS value,
               CAST(l_shipdate AS DATE) AS ship, CAST(o_orderdate AS DATE) AS ordered,
               o_orderpriority, o_totalprice, o_custkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "d_rev": """
        SELECT instrument_id, CAST(year(ordered) AS INTEGER) AS year, CAST(month(ordered) AS INTEGER) AS month,
               CAST(sum(value) AS DOUBLE) / 10000e0 AS revenue
        FROM d_lines GROUP BY ALL""",
    "d_revcum": """
        SELECT a.instrument_id, a.year, a.month, a.revenue, p.revenue AS prior,
               (SELECT sum(c.revenue) FROM d_rev c WHERE c.instrument_id = a.instrument_id AND c.year = a.year AND c.month <= a.month) AS cum,
               (SELECT sum(c.revenue) FROM d_rev c WHERE c.instrument_id = a.instrument_id AND c.year = a.year - 1 AND c.month <= a.month) AS cum_prior,
               (SELECT count(*) FROM d_rev c WHERE c.instrument_id = a.instrument_id AND c.year = a.year - 1 AND c.month <= a.month) AS n_prior
        FROM d_rev a LEFT JOIN d_rev p ON p.instrument_id = a.instrument_id AND p.year = a.year - 1 AND p.month = a.month""",
    "d_revp": """
        SELECT instrument_id,
               CAST(make_date(year, month, 1) + INTERVAL 1 MONTH + INTERVAL 9 DAY AS DATE) AS pub_date,
               strftime(make_date(year, month, 1), '%Y-%m') AS ym,
               round(CASE WHEN prior > 0 THEN (revenue - prior) / prior * 100 END, 2) + 0e0 AS yoy,
               round(CASE WHEN n_prior = month AND cum_prior > 0 THEN (cum - cum_prior) / cum_prior * 100 END, 2) + 0e0 AS cum_yoy
        FROM d_revcum
        WHERE prior > 0 OR (n_prior = month AND cum_prior > 0)""",
    "d_val": """
        SELECT f.date, t.instrument_id, t.y AS "yield", t.per, t.pbr
        FROM (SELECT instrument_id, CAST(date_trunc('month', date) AS DATE) AS m,
                     CAST(sum(disc) AS DOUBLE) / count(*) AS y, sum(qty) / count(*) AS per,
                     CAST(sum(tax) AS DOUBLE) * 0.5e0 / count(*) AS pbr
              FROM d_trades GROUP BY ALL) t
        JOIN (SELECT CAST(date_trunc('month', date) AS DATE) AS m, min(date) AS date FROM d_cal GROUP BY ALL) f USING (m)""",
    "d_tiers": """
        SELECT date, instrument_id, level, q * 100 / sum(q) OVER (PARTITION BY instrument_id, date) AS percent
        FROM (SELECT instrument_id, CAST(date_trunc('month', ordered) AS DATE) AS date,
                     CASE WHEN o_totalprice >= 300000 THEN 15 WHEN o_totalprice >= 250000 THEN 14
                          WHEN o_totalprice >= 200000 THEN 13 WHEN o_totalprice >= 150000 THEN 12
                          ELSE CAST(floor(o_totalprice / 15000) AS INTEGER) + 1 END AS level,
                     sum(qty) AS q FROM d_lines GROUP BY ALL)""",
    "d_hold": """
        SELECT date, instrument_id, round(coalesce(sum(percent) FILTER (WHERE level = 15), 0e0), 2) AS pct_1000,
               round(coalesce(sum(percent) FILTER (WHERE level BETWEEN 12 AND 15), 0e0), 2) AS pct_400
        FROM d_tiers GROUP BY date, instrument_id""",
    "d_quarter": """
        SELECT instrument_id, CAST(date_trunc('quarter', ordered) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date,
               CAST(sum(value) AS DOUBLE) AS v,
               CAST(sum(CASE WHEN flag = 'R' THEN value ELSE 0 END) AS DOUBLE) AS v_r,
               CAST(sum(CASE WHEN status = 'O' THEN value ELSE 0 END) AS DOUBLE) AS v_o,
               CAST(sum(cents) AS DOUBLE) AS cents, sum(qty) AS q,
               sum(CASE WHEN flag = 'N' THEN qty ELSE 0e0 END) AS q_n
        FROM d_lines GROUP BY ALL""",
    "d_wide": """
        SELECT instrument_id, date, v / 10000e0 AS revenue, (v - v_r) / 10000e0 AS gross_profit,
               (v - v_r - v_o * 0.5e0) / 10000e0 AS operating_income,
               (v - v_r * 1.5e0 - v_o * 0.5e0) / 10000e0 AS net_income,
               (v - v_r * 1.5e0 - v_o * 0.5e0) / 10000000e0 AS eps,
               cents * 4 / 100e0 AS total_assets, v_o / 5000e0 AS liabilities,
               (cents * 400 - v_o * 2) / 10000e0 AS equity, q * 1000e0 AS current_assets,
               CASE WHEN q_n > 0 THEN q_n * 2000e0 END AS current_liabilities, q * 500e0 AS share_capital,
               sum(v - v_r) OVER y / 20000e0 AS operating_cash_flow,
               sum(v_o) OVER y / -40000e0 AS capital_expenditure
        FROM d_quarter
        WINDOW y AS (PARTITION BY instrument_id, year(date) ORDER BY date)""",
    "d_stmt": """
        SELECT instrument_id, date, type, value FROM d_wide
        UNPIVOT (value FOR type IN (revenue, gross_profit, operating_income, net_income, eps, total_assets,
            liabilities, equity, current_assets, current_liabilities, share_capital,
            operating_cash_flow, capital_expenditure))""",
    "d_div": """
        SELECT instrument_id, concat(year(date) - 1911, '年第', quarter(date), '季') AS year,
               CASE WHEN quarter(date) = 2 THEN q % 3 ELSE 0e0 END AS cash,
               CASE WHEN quarter(date) = 3 THEN q % 2 ELSE 0e0 END AS share_dividend
        FROM d_quarter""",
    "d_notices": """
        SELECT DISTINCT CAST(instrument_id AS VARCHAR) AS code, ordered AS start_date, ship AS end_date,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'restricted' ELSE 'attention' END AS kind
        FROM d_lines WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND ship >= ordered""",
    "d_exdiv": """
        SELECT DISTINCT instrument_id, ship AS date, CASE WHEN status = 'F' THEN qty END AS cash,
               CASE WHEN flag = 'R' AND disc > 0 THEN CAST(disc AS DOUBLE) END AS share_dividend
        FROM d_lines WHERE o_orderpriority = '5-LOW'""",
    "d_share": """
        SELECT instrument_id, CAST(date - INTERVAL 1 DAY AS DATE) AS date,
               abs(foreign_net) * 100 / volume AS foreign_pct, volume * 100000e0 AS shares_issued
        FROM d_panel""",
    "d_holdings": """
        SELECT instrument_id, arg_min(volume, date) AS lots, arg_min(close, date) AS cost,
               arg_min(close, date) * 0.8e0 AS stop, arg_min(close, date) * 1.2e0 AS target
        FROM d_bars WHERE date >= DATE '2001-01-01' GROUP BY instrument_id""",
    "d_requests": """
        SELECT p.o_custkey AS account_id, instrument_id, c_acctbal * 10000 AS account
        FROM (SELECT DISTINCT o_custkey, instrument_id FROM d_lines) p JOIN customer ON o_custkey = c_custkey""",
    "d_quotes": """
        SELECT user_id AS symbol, ts, event_type, value AS price, props FROM events""",
}

_NAME = re.compile(r"\bd_[a-z]+\b")


def oracle(body: str, **extra: str) -> str:
    """``body`` behind the WITH clause of every domain table it needs.

    ``extra`` adds intermediate tables of one query, named ``d_…`` or otherwise.
    """
    tables = {**TABLES, **extra}
    done: list[str] = []

    def need(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if name in tables and name not in done and tables[name] is not sql:
                need(tables[name])
                if name not in done:
                    done.append(name)

    need(body)
    if not done:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({tables[name].strip()})" for name in done)
    return f"WITH {ctes}\n{body.strip()}"
