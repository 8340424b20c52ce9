from __future__ import annotations

import re
from datetime import date

import pytest

from tapeframe.operators import fundamentals as fund
from tapeframe.operators import landmines
from tapeframe.operators.joins import wide
from tapeframe.sources.normalize import concentration_from_tiers, normalize_revenue

from .conftest import days


def revenue(frame, values):
    return frame("instrument_id long, year int, month int, revenue double", *[(1, y, m, float(v)) for (y, m), v in values.items()])


def test_monthly_revenue(frame):
    values = {(2024, m): 100e8 for m in range(1, 13)} | {(2025, 1): 130e8, (2025, 2): 120e8}
    rows = {(r.year, r.month): r for r in fund.monthly_revenue(revenue(frame, values)).collect()}
    last = rows[(2025, 2)]
    assert (round(last.yoy, 1), round(last.mom, 1), round(last.cum_yoy, 1)) == (20.0, -7.7, 25.0)


def test_revenue_panel_needs_every_prior_month(frame):
    values = {(2024, 1): 100, (2024, 3): 100, (2025, 1): 110, (2025, 3): 130}
    rows = {r.ym: r for r in fund.revenue_yoy_panel(revenue(frame, values)).collect()}
    assert rows["2025-01"].cum_yoy == 10.0 and rows["2025-03"].cum_yoy is None and rows["2025-03"].yoy == 30.0
    assert str(rows["2025-03"].pub_date) == "2025-04-10"
    assert "2024-01" not in rows


def test_missing_month_is_not_twelve_rows_back(frame):
    values = {(2024, m): 100 + m for m in range(1, 13) if m != 5} | {(2025, 6): 212}
    rows = {r.ym: r for r in fund.revenue_yoy_panel(revenue(frame, values)).collect()}
    assert rows["2025-06"].yoy == 100.0


def statements(frame, items):
    rows = [(1, d, t, float(v)) for d, kinds in items.items() for t, v in kinds.items() if v is not None]
    return frame("instrument_id long, date string, type string, value double", *rows).selectExpr("instrument_id", "cast(date as date) date", "type", "value")


def test_profitability(frame):
    q = ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2025-03-31"]
    items = {d: {"revenue": 1000, "gross_profit": 500, "operating_income": 300, "net_income": 200, "eps": 2.0 if i == 4 else 1.0} for i, d in enumerate(q)}
    r = {str(x.date): x for x in fund.profitability(statements(frame, items)).collect()}["2025-03-31"]
    assert (r.gross_margin, r.operating_margin, r.net_margin, r.eps_yoy) == (50.0, 30.0, 20.0, 100.0)


def test_year_to_date_cash_is_split_into_quarters(frame):
    q = ["2025-03-31", "2025-06-30", "2025-09-30", "2025-12-31"]
    ytd, capex = [100e8, 250e8, 400e8, 600e8], [-20e8, -70e8, -100e8, -150e8]
    items = {
        d: {
            "operating_cash_flow": ytd[i], "capital_expenditure": capex[i], "net_income": 100e8, "equity": 1400e8, "share_capital": 200e8,
            "total_assets": 2000e8, "liabilities": 600e8, "current_assets": 900e8, "current_liabilities": 300e8, "revenue": 1,
        }
        for i, d in enumerate(q)
    }
    rows = {str(r.date): r for r in fund.financial_health(statements(frame, items)).collect()}
    assert [rows[d].operating_cash / 1e8 for d in q] == [100, 150, 150, 200]
    second = rows["2025-06-30"]
    assert (second.cash_quality, second.free_cash / 1e8, second.book_value) == (150.0, 100.0, 70.0)
    assert (second.debt_ratio, second.current_ratio) == (30.0, 300.0) and second.roe is None
    assert rows["2025-12-31"].roe == pytest.approx(400 / 1400 * 100)


def test_dividend_streak_adds_quarters_of_a_year(frame):
    d = frame(
        "instrument_id long, year string, cash double, share_dividend double",
        (1, "112年", 3.0, 0.0), (1, "113年第1季", 1.0, 0.0), (1, "113年第2季", 1.0, None), (1, "113年第3季", 2.0, 0.5), (2, "111年", 1.0, 0.0), (2, "112年", 0.0, 0.0),
    )
    years = {(r.instrument_id, r.year): (r.cash, r.share_dividend) for r in fund.dividend_years(d).collect()}
    assert years[(1, 2024)] == (4.0, 0.5) and years[(1, 2023)] == (3.0, 0.0)
    assert {r.instrument_id: r.dividend_years for r in fund.dividend_streak(d).collect()} == {1: 2, 2: 0}


def test_eps_growth_needs_eight_quarters(frame):
    q = [f"{2020 + i // 4}-{3 * (i % 4) + 3:02d}-28" for i in range(8)]
    full = statements(frame, {d: {"eps": 1.0 if i < 4 else 1.5} for i, d in enumerate(q)})
    r = fund.eps_ttm_growth(full).collect()[0]
    assert (r.eps_ttm, r.eps_growth) == (6.0, 50.0)
    short = fund.eps_ttm_growth(statements(frame, {d: {"eps": 1.0} for d in q[:5]})).collect()[0]
    assert short.eps_ttm == 4.0 and short.eps_growth is None


@pytest.mark.parametrize("last, label", [((51, 31, 21), "all up"), ((49, 29, 19), "all down"), ((51, 29, 19), "1 up 2 down"), ((None, 1, 1), "-")])
def test_three_rates(frame, last, label):
    rows = [(1, days(1)[0], 50.0, 30.0, 20.0), (1, days(2)[1], *[None if x is None else float(x) for x in last])]
    prof = frame("instrument_id long, date date, gross_margin double, operating_margin double, net_margin double", *rows)
    assert fund.three_rates_label(prof).collect()[0].three_rates == label


def test_concentration(frame):
    d = days(1)[0]
    tiers = frame("date date, instrument_id long, level int, percent double", (d, 1, 15, 40.1), (d, 1, 14, 5.0), (d, 1, 12, 2.5), (d, 1, 11, 9.0))
    r = concentration_from_tiers(tiers).collect()[0]
    assert (r.pct_1000, r.pct_400) == (40.1, 47.6)


def test_publication_date_fallback(frame):
    raw = frame(
        "code string, year int, month int, revenue string, created string",
        ("1101", 2024, 12, "1,234", ""), ("1101", 2024, 11, "5", "2024-12-07 10:00:00"), ("1101", None, 1, "5", ""),
    )
    got = {r.month: (r.revenue, str(r.pub_date)) for r in normalize_revenue(raw).collect()}
    assert got == {12: (1234.0, "2025-01-10"), 11: (5.0, "2024-12-07")}


def test_peers_leave_the_instrument_out(frame, bars):
    price = bars({i: [10.0 * i] for i in range(1, 8)})
    info = frame("instrument_id long, instrument_name string, industry string, type string", *[(i, f"n{i}", "x" if i < 6 else "y", "twse") for i in range(1, 8)])
    got = {}
    for r in fund.industry_peers(price, info, 2).orderBy("instrument_id", "rank").collect():
        got.setdefault(r.instrument_id, []).append(r.peer_id)
    assert got[1] == [5, 4] and got[5] == [4, 3] and got[4] == [5, 3] and got[6] == [7]


def test_landmine_level_order(frame):
    df = frame("instrument_id long, risk_level string", (1, "low"), (2, "mid"), (3, "high"), (4, "severe"))
    assert {r.instrument_id for r in landmines.at_least(df, "high").collect()} == {3, 4}


def test_wide_picks_items_before_the_shuffle(frame):
    """A report crosses one exchange as one row; a repeated item has its first value, null included."""
    d = days(2)
    schema = "instrument_id long, date date, type string, value double"
    rows = [(1, d[0], "a", 1.0), (1, d[0], "b", 2.0), (1, d[1], "x", 3.0), (None, d[0], "b", 4.0), (2, None, "a", 5.0), (3, d[0], "a", None), (3, d[0], "a", 6.0), (4, d[0], "b", 7.0), (4, d[0], "b", None)]
    got = wide(frame(schema, *rows).coalesce(1), ("a", "b"))
    want = {(1, d[0], 1.0, 2.0), (1, d[1], None, None), (None, d[0], None, 4.0), (2, None, 5.0, None), (3, d[0], None, None), (4, d[0], None, 7.0)}
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["instrument_id", "date", "a", "b"]
    many = wide(frame(schema, *rows).repartition(2), ("a", "b"))
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_landmine_reports_are_widened_once(frame):
    """The margin a year before comes from the instrument's own row, not from the statements again."""
    d = [date(2023, 3, 31), date(2023, 6, 30), date(2024, 3, 31), date(2024, 2, 29)]
    item = "instrument_id long, date date, type string, value double"
    rows = [(s, x, t, v) for s, x, g in ((1, d[0], 40.0), (1, d[1], 30.0), (1, d[2], 20.0), (2, d[3], 10.0), (None, d[0], 5.0), (None, d[2], 6.0)) for t, v in (("gross_profit", g), ("revenue", 100.0), ("eps", 1.0), ("net_income", g))]
    out = landmines.fundamental_context(revenue(frame, {(2024, 1): 1.0}), frame(item, *rows).repartition(2))
    assert len(re.findall(r"hashpartitioning\(instrument_id#\d+L, date#", out._jdf.queryExecution().executedPlan().toString())) == 1
    got = {r.instrument_id: (r.date, r.net_income, r.gm, r.n_eps, r.gm_before) for r in out.collect()}
    assert got == {1: (d[2], 20.0, 20.0, 3, 40.0), 2: (d[3], 10.0, 10.0, 1, None), None: (d[2], 6.0, 6.0, 2, None)}
