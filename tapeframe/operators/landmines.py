"""Red flags before buying or holding: technical, flow and fundamental."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Landmine
from ..functions.columns import ratio, tag_text, tags
from ..functions.quantiles import exact_median, with_scalar
from ..functions.windows import deepening_streaks, newest_first, top_rows
from ..sources.calendar import on_last_dates
from .flows import holder_change_own
from .fundamentals import INCOME_ITEMS, eps_ttm_growth, revenue_summary
from .joins import enrich, wide

CHART_FLAGS = ("below ma60", "weak vs market", "institutions selling", "margin surge", "big holders leaving")
FUND_FLAGS = ("revenue slump", "revenue crash", "earnings collapse", "four-quarter loss", "quarter loss", "margin erosion")


def chart_context(
    ids: DataFrame, price: DataFrame, inst: DataFrame, margin: DataFrame, holders: DataFrame, info: DataFrame, calendar: DataFrame, p: Landmine
) -> DataFrame:
    rows = top_rows(price.select("instrument_id", "date", "close"), newest_first("instrument_id"), p.ma_long)
    own = rows.groupBy("instrument_id").agg(
        F.max_by("close", "date").alias("close"), F.count(F.lit(1)).alias("rows"), F.avg("close").alias("mean"),
        # the close min(lookback, rows - 1) steps back
        F.min_by(F.when(F.col("rank") <= p.lookback + 1, F.col("close")), F.when(F.col("rank") <= p.lookback + 1, F.col("date"))).alias("base"),
    )
    market = on_last_dates(price, calendar, p.lookback + 1).groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("close", "date").alias("c0"), F.max_by("close", "date").alias("c1")
    ).filter("n >= 2 AND c0 > 0").select((ratio(F.col("c1") - F.col("c0"), F.col("c0")) * 100).alias("ret"))
    own = with_scalar(own, exact_median(market, "ret"), "median")
    rel = F.when(
        (F.least(F.lit(p.lookback), F.col("rows") - 1) >= 5) & (F.col("base") > 0),
        ratio(F.col("close") - F.col("base"), F.col("base")) * 100 - F.coalesce("median", F.lit(0.0)),
    )
    net = F.when(F.col("type") == "tpex", F.col("foreign_net")).otherwise(F.col("trust_net"))
    chosen = inst.join(info.select("instrument_id", "type"), "instrument_id", "left").select("instrument_id", "date", net.alias("net"))
    # the flag asks for so many days only
    selling = deepening_streaks(chosen, calendar, ids, {"net": "streak"}, enough=p.sell_days)
    balance = margin.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("mn"), F.min_by("margin_balance", "date").alias("m0"), F.max_by("margin_balance", "date").alias("m1")
    )
    surge = F.when((F.col("mn") >= 2) & (F.col("m0") > 0), ratio(F.col("m1") - F.col("m0"), F.col("m0")))
    return (
        own.withColumn("vs_market_pct", rel)
        .withColumn("ma_long", F.when(F.col("rows") >= p.ma_long, F.col("mean")))
        .join(selling, "instrument_id", "left")
        .join(balance.select("instrument_id", surge.alias("margin_growth")), "instrument_id", "left")
        .join(holder_change_own(holders), "instrument_id", "left")
        .select("instrument_id", "close", "ma_long", "vs_market_pct", "streak", "margin_growth", "holder_pct", "holder_change")
    )


def fundamental_context(revenue: DataFrame, statements: DataFrame) -> DataFrame:
    """Newest report, its gross margin a year before, revenue and earnings growth.

    The reports of an instrument, one a quarter, are packed into its row, where the one a
    year before is looked up: statements are widened once.
    """
    q = wide(statements, INCOME_ITEMS)
    q = q.withColumn("gm", ratio(F.col("gross_profit") * 100, F.col("revenue")))
    reports = q.groupBy("instrument_id").agg(
        F.max_by(F.struct("date", "net_income", "gm"), "date").alias("q"), F.count("eps").alias("n_eps"),
        F.collect_list(F.struct(F.add_months("date", 12).alias("at"), F.col("gm").alias("gm_before"))).alias("all"),
    )
    year_ago = F.filter("all", lambda x: (x.at == F.col("q.date")) & F.col("instrument_id").isNotNull())
    last = reports.select("instrument_id", "q.*", "n_eps", F.inline_outer(year_ago)).drop("at")
    return last.join(revenue_summary(revenue), "instrument_id", "outer").join(eps_ttm_growth(statements), "instrument_id", "left")


def landmine_flags(
    ids: DataFrame, price: DataFrame, inst: DataFrame, margin: DataFrame, holders: DataFrame, info: DataFrame,
    revenue: DataFrame, statements: DataFrame, calendar: DataFrame, p: Landmine = Landmine(),
) -> DataFrame:
    """Every given instrument with its flags, their number and a level."""
    ctx = enrich(
        enrich(ids.select("instrument_id"), chart_context(ids, price, inst, margin, holders, info, calendar, p)),
        fundamental_context(revenue, statements),
    )
    chart = tags(*zip(
        (
            F.col("close") < F.col("ma_long"), F.col("vs_market_pct") <= p.weak_vs_market, F.col("streak") <= -p.sell_days,
            F.col("margin_growth") >= p.margin_surge, F.col("holder_change") <= -p.holder_drop,
        ),
        CHART_FLAGS,
    ))
    enough = F.col("n_eps") >= 8
    fund = tags(*zip(
        (
            F.col("mean3_yoy") <= p.revenue_bad, F.col("last_yoy") <= p.revenue_crash,
            enough & (F.col("eps_growth") <= p.eps_drop), enough & (F.col("eps_ttm") < 0),
            F.col("net_income") < 0, F.col("gm_before") - F.col("gm") >= p.margin_drop,
        ),
        FUND_FLAGS,
    ))
    out = ctx.withColumn("chart", chart).withColumn("fund", fund)
    score = F.size("chart") + F.size("fund")
    level = F.when(score >= p.severe, "severe").when(score >= p.high, "high").when(score >= p.mid, "mid").otherwise("low")
    return out.select(
        "instrument_id", score.alias("risk_score"), level.alias("risk_level"), F.size("fund").alias("n_fund_flags"),
        tag_text(F.concat("chart", "fund"), "; ").alias("red_flags"),
        "close", "vs_market_pct", "holder_pct", "last_yoy", "mean3_yoy", "eps_ttm", "eps_growth", F.col("gm").alias("gross_margin"),
    )


# Order of the risk levels.
LEVEL_RANK = ("low", "mid", "high", "severe")


def at_least(df: DataFrame, floor: str, level: str = "risk_level") -> DataFrame:
    """Rows whose level is at or above ``floor``."""
    order = F.create_map(*[x for i, name in enumerate(LEVEL_RANK) for x in (F.lit(name), F.lit(i))])
    return df.filter(F.element_at(order, F.col(level)) >= LEVEL_RANK.index(floor))
