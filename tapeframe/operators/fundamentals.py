"""Fundamental time series: revenue growth, statements, dividends, valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import local_year, pct, pct_simple, ratio, vote
from ..functions.windows import latest_streaks, newest_first, ordered, trailing
from ..session import cut_lineage
from .joins import enrich, previous_year, wide

# Statement items the metrics read.
INCOME_ITEMS = ("revenue", "gross_profit", "operating_income", "net_income", "eps")
BALANCE_ITEMS = (
    "total_assets", "liabilities", "current_assets", "current_liabilities", "equity", "share_capital",
)
CASH_ITEMS = ("operating_cash_flow", "capital_expenditure")
PAR_VALUE = 10


def revenue_year_to_date(revenue: DataFrame) -> DataFrame:
    """Adds prior (same month last year), cum, cum_prior and n_prior.

    A instrument-year is packed into one row of at most twelve months, so last year's
    cumulative value needs neither a self-join nor the month itself to exist.
    """
    w = Window.partitionBy("instrument_id").orderBy("year")
    years = revenue.groupBy("instrument_id", "year").agg(
        F.sort_array(F.collect_list(F.struct("month", "revenue"))).alias("months")
    )
    last = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("months").over(w))
    rows = years.withColumn("before", F.coalesce(last, F.array().cast("array<struct<month:int,revenue:double>>")))
    rows = rows.withColumn("cur", F.explode("months"))
    month = F.col("cur.month")

    def upto(arr: str) -> Column:
        return F.filter(arr, lambda x: x.month <= month)

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.revenue)

    exact = F.get(F.filter("before", lambda x: x.month == month), F.lit(0))
    return rows.select(
        "instrument_id", "year", month.alias("month"), F.col("cur.revenue").alias("revenue"),
        exact.getField("revenue").alias("prior"),
        total(upto("months")).alias("cum"),
        F.when(F.size(upto("before")) > 0, total(upto("before"))).alias("cum_prior"),
        F.size(upto("before")).alias("n_prior"),
    )


def revenue_yoy_panel(revenue: DataFrame, created: str | None = None) -> DataFrame:
    """(instrument_id, pub_date, ym, yoy, cum_yoy) per revenue month.

    Cumulative growth needs every month of last year up to this one.  Published on
    the 10th of the next month.
    """
    ytd = revenue_year_to_date(revenue)
    cum_yoy = F.when(F.col("n_prior") == F.col("month"), pct_simple("cum", "cum_prior"))
    first = F.make_date("year", "month", F.lit(1))
    return (
        ytd.select(
            "instrument_id",
            F.date_add(F.add_months(first, 1), 9).alias("pub_date"),
            F.date_format(first, "yyyy-MM").alias("ym"),
            F.round(pct_simple("revenue", "prior"), 2).alias("yoy"),
            F.round(cum_yoy, 2).alias("cum_yoy"),
        )
        .filter(F.col("yoy").isNotNull() | F.col("cum_yoy").isNotNull())
    )


def monthly_revenue(revenue: DataFrame) -> DataFrame:
    """Growth on the year, on the month and cumulative, per revenue month."""
    w = Window.partitionBy("instrument_id").orderBy("__m")
    ytd = revenue_year_to_date(revenue).withColumn("__m", F.col("year") * 12 + F.col("month"))
    before = F.when(F.lag("__m").over(w) == F.col("__m") - 1, F.lag("revenue").over(w))
    return ytd.select(
        "instrument_id", "year", "month", "revenue",
        pct("revenue", "prior").alias("yoy"), pct("revenue", before).alias("mom"), pct("cum", "cum_prior").alias("cum_yoy"),
    )


def latest_revenue(revenue: DataFrame) -> DataFrame:
    """Newest revenue month of each instrument in the form the momentum screen reads."""
    w = Window.partitionBy("instrument_id").orderBy("__m")
    ytd = revenue_year_to_date(revenue).withColumn("__m", F.col("year") * 12 + F.col("month"))
    before = F.when(F.lag("__m").over(w) == F.col("__m") - 1, F.lag("revenue").over(w))
    cum_yoy = F.when(F.col("n_prior") == F.col("month"), pct_simple("cum", "cum_prior"))
    rows = ytd.select(
        "instrument_id", "__m",
        F.date_format(F.make_date("year", "month", F.lit(1)), "yyyy-MM").alias("ym"),
        F.round(pct_simple("revenue", "prior"), 2).alias("yoy"), F.round(cum_yoy, 2).alias("cum_yoy"),
        F.round(pct_simple("revenue", before), 1).alias("mom"),
    ).filter(F.col("yoy").isNotNull() | F.col("cum_yoy").isNotNull())
    return rows.groupBy("instrument_id").agg(
        F.max_by(F.struct("ym", "yoy", "cum_yoy", "mom"), "__m").alias("last")
    ).select("instrument_id", "last.*")


def revenue_summary(revenue: DataFrame) -> DataFrame:
    """(instrument_id, revenue_month, last_yoy, mean3_yoy) from the months that have a base."""
    months = revenue_year_to_date(revenue).filter("prior > 0").select(
        "instrument_id", (F.col("year") * 12 + F.col("month")).alias("m"),
        F.date_format(F.make_date("year", "month", F.lit(1)), "yyyy/MM").alias("ym"),
        pct_simple("revenue", "prior").alias("yoy"),
    )
    last3 = Window.partitionBy("instrument_id").orderBy(F.col("m").desc())
    ranked = months.withColumn("rank", F.row_number().over(last3)).filter("rank <= 3")
    return ranked.groupBy("instrument_id").agg(
        F.max_by("ym", "m").alias("revenue_month"), F.max_by("yoy", "m").alias("last_yoy"), F.avg("yoy").alias("mean3_yoy"),
    )


def profitability(statements: DataFrame) -> DataFrame:
    """Margins per report and earnings against four reports earlier."""
    w = ordered("instrument_id")
    q = wide(statements, INCOME_ITEMS).filter("revenue is not null or eps is not null")

    def margin(item: str) -> Column:
        return ratio(F.col(item) * 100, F.col("revenue"))

    return q.select(
        "instrument_id", "date",
        margin("gross_profit").alias("gross_margin"), margin("operating_income").alias("operating_margin"),
        margin("net_income").alias("net_margin"), "eps", pct("eps", F.lag("eps", 4).over(w)).alias("eps_yoy"),
    )


def single_quarter(c: str) -> Column:
    """Year-to-date value to the quarter's own: difference within the year, the first quarter as is."""
    w = Window.partitionBy("instrument_id", F.year("date")).orderBy("date")
    return F.when(F.month("date") <= 3, F.col(c)).otherwise(F.col(c) - F.lag(c).over(w))


def financial_health(statements: DataFrame) -> DataFrame:
    """Return on equity over four quarters, leverage, liquidity, book value and cash quality."""
    q = wide(statements, (*BALANCE_ITEMS, *CASH_ITEMS, "net_income"))
    four = trailing(ordered("instrument_id"), 4)
    ttm = F.when(F.count("net_income").over(four) == 4, F.sum("net_income").over(four))
    # the quarter windows refine the instrument windows' partitioning, so all share one shuffle
    f = q.withColumns({"ttm": ttm, "ocf": single_quarter("operating_cash_flow"), "capex": single_quarter("capital_expenditure")})
    return f.select(
        "instrument_id", "date",
        (ratio("ttm", "equity") * 100).alias("roe"),
        (ratio("liabilities", "total_assets") * 100).alias("debt_ratio"),
        (ratio("current_assets", "current_liabilities") * 100).alias("current_ratio"),
        ratio(F.col("equity") * PAR_VALUE, "share_capital").alias("book_value"),
        F.col("ocf").alias("operating_cash"), (ratio("ocf", "net_income") * 100).alias("cash_quality"),
        (F.col("ocf") + F.col("capex")).alias("free_cash"),
    )


def three_rates_label(profit: DataFrame) -> DataFrame:
    """Whether all three margins rose or fell between the two newest reports."""
    rates = ("gross_margin", "operating_margin", "net_margin")
    w = newest_first("instrument_id")
    two = profit.select("instrument_id", "date", *[F.round(c, 1).alias(c) for c in rates]).withColumn("k", F.row_number().over(w)).filter("k <= 2")
    ups, known = F.lit(0), F.lit(True)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in rates:
        aggs += [F.max(F.when(F.col("k") == 1, F.col(c))).alias(c), F.max(F.when(F.col("k") == 2, F.col(c))).alias(f"prev_{c}")]
        ups = ups + F.when(F.col(c) > F.col(f"prev_{c}"), 1).otherwise(0)
        known = known & F.col(c).isNotNull() & F.col(f"prev_{c}").isNotNull()
    label = (
        F.when((F.col("n") < 2) | ~known, "-").when(ups == 3, "all up").when(ups == 0, "all down")
        .otherwise(F.concat(ups.cast("string"), F.lit(" up "), (3 - ups).cast("string"), F.lit(" down")))
    )
    return two.groupBy("instrument_id").agg(*aggs).select("instrument_id", label.alias("three_rates"))


def eps_ttm_growth(statements: DataFrame) -> DataFrame:
    """Sum of the newest four quarterly earnings and its growth on the four before."""
    w = newest_first("instrument_id")
    eps = statements.filter(F.col("type") == "eps").withColumn("k", F.row_number().over(w)).filter("k <= 8")
    s = eps.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") <= 4, F.col("value"))).alias("eps_ttm"),
        F.sum(F.when(F.col("k") > 4, F.col("value"))).alias("before"),
    )
    growth = F.when((F.col("n") >= 8), pct("eps_ttm", "before"))
    return s.filter("n >= 4").select("instrument_id", "eps_ttm", growth.alias("eps_growth"))


def valuation_latest(valuation: DataFrame) -> DataFrame:
    return valuation.groupBy("instrument_id").agg(F.max_by(F.struct("per", "pbr", "yield"), "date").alias("v")).select("instrument_id", "v.*")


def valuation_position(valuation: DataFrame, days: int = 400, min_values: int = 20) -> DataFrame:
    """Place of the newest earnings multiple in the range of the last year's."""
    newest = valuation.agg(F.max("date").alias("d")).select("d").scalar()
    recent = valuation.filter(F.col("date") >= F.date_sub(newest, days))
    per = F.when(F.col("per") != 0, F.col("per"))
    s = recent.groupBy("instrument_id").agg(
        F.max_by(F.struct("per", "pbr", "yield"), "date").alias("v"),
        F.count(per).alias("n"), F.max(per).alias("hi"), F.min(per).alias("lo"),
    )
    ok = (F.col("n") >= min_values) & (F.col("v.per") != 0) & (F.col("hi") > F.col("lo"))
    return s.select(
        "instrument_id", "v.per", "v.pbr", "v.yield",
        F.when(ok, ratio(F.col("v.per") - F.col("lo"), F.col("hi") - F.col("lo")) * 100).alias("per_position"),
    )


def dividend_years(dividends: DataFrame) -> DataFrame:
    """Cash and share dividends per year; quarterly rows of one local-calendar year add up."""
    return dividends.withColumn("y", local_year("year")).filter(F.col("y").isNotNull()).groupBy(
        "instrument_id", F.col("y").alias("year")
    ).agg(F.sum(F.coalesce("cash", F.lit(0.0))).alias("cash"), F.sum(F.coalesce("share_dividend", F.lit(0.0))).alias("share_dividend"))


def dividend_streak(dividends: DataFrame) -> DataFrame:
    """Years in a row, counted back from the newest, with a cash dividend."""
    streak = latest_streaks(dividend_years(dividends), "instrument_id", {"cash": "streak"}, by="year")
    return streak.select("instrument_id", F.greatest("streak", F.lit(0)).alias("dividend_years"))


def fundamental_note(df: DataFrame, yoy: str = "last_yoy", per: str = "per") -> DataFrame:
    """Adds a short text on growth and price."""
    g, p = F.col(yoy), F.col(per)
    whole = lambda c: F.bround(c).cast("long").cast("string")
    growth = (
        F.when(g.isNull(), "no revenue data").when(g >= 20, F.concat(F.lit("strong growth +"), whole(g), F.lit("%")))
        .when(g >= 0, F.concat(F.lit("mild growth +"), whole(g), F.lit("%"))).otherwise(F.concat(F.lit("shrinking "), whole(g), F.lit("%")))
    )
    price = (
        F.when(p <= 0, "loss or odd multiple").when(p > 40, F.concat(F.lit("expensive at "), whole(p)))
        .when(p.isNotNull(), F.concat(F.lit("multiple "), whole(p)))
    )
    return df.withColumn("note", F.concat_ws(", ", growth, price))


def fundamental_shortlist(ids: DataFrame, revenue: DataFrame, valuation: DataFrame) -> DataFrame:
    """Newest growth and valuation of the given instruments, with a note."""
    picked = enrich(enrich(ids.select("instrument_id"), revenue_summary(revenue)), valuation_latest(valuation))
    return fundamental_note(picked)


def fundamental_vote(
    summary: DataFrame, eps: DataFrame, health: DataFrame, rates: DataFrame, flags: DataFrame
) -> DataFrame:
    """Votes from margins, growth, earnings, cash quality and red flags."""
    quality = health.filter("cash_quality is not null").groupBy("instrument_id").agg(F.max_by("cash_quality", "date").alias("cash_quality"))
    j = rates
    for other in (summary, eps, quality, flags.select("instrument_id", "n_fund_flags")):
        j = enrich(j, other)
    votes = (
        F.when(F.col("three_rates") == "all up", 1).when(F.col("three_rates") == "all down", -1).otherwise(0)
        + vote("last_yoy", 15, -10) + vote("eps_growth", 15, -15)
        + F.when(F.col("cash_quality") >= 80, 1).when(F.col("cash_quality") < 40, -1).otherwise(0)
        - F.when(F.col("n_fund_flags") > 0, 1).otherwise(0)
    )
    return j.select("instrument_id", "three_rates", "last_yoy", "eps_growth", "cash_quality", votes.alias("fund_votes"))


def industry_peers(price: DataFrame, info: DataFrame, n: int = 5) -> DataFrame:
    """The n most traded other instruments of each instrument's industry on the newest date.

    The n + 1 leaders of an industry are found first; every member then meets only them.
    """
    newest = price.agg(F.max("date").alias("d")).select("d").scalar()
    traded = price.filter((F.col("date") == newest) & (F.col("volume") > 0)).select(
        F.col("instrument_id"), (F.col("close") * F.col("volume")).alias("amount")
    )
    lead = Window.partitionBy("industry").orderBy(F.col("amount").desc(), "instrument_id")
    leaders = (
        info.filter(F.col("industry").isNotNull()).join(traded, "instrument_id")
        .withColumn("k", F.row_number().over(lead)).filter(F.col("k") <= n + 1)
        .select("industry", F.col("instrument_id").alias("peer_id"), F.col("instrument_name").alias("peer_name"), "k")
    )
    leaders = cut_lineage(leaders, "leaders")  # n + 1 rows per industry: the stored size lets the planner broadcast them
    own = Window.partitionBy("instrument_id").orderBy("k")
    return (
        info.select("instrument_id", "industry").join(leaders, "industry").filter("peer_id <> instrument_id")
        .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= n)
        .select("instrument_id", "industry", "rank", "peer_id", "peer_name")
    )


def peer_table(peers: DataFrame, info: DataFrame, revenue: DataFrame, valuation: DataFrame) -> DataFrame:
    """Each instrument (rank 0) beside its peers: valuation and newest revenue growth."""
    rows = peers.select("instrument_id", "rank", "peer_id", "peer_name").unionByName(
        peers.select("instrument_id").distinct().join(info, "instrument_id").select(
            "instrument_id", F.lit(0).alias("rank"), F.col("instrument_id").alias("peer_id"), F.col("instrument_name").alias("peer_name")
        )
    )
    metrics = enrich(valuation_latest(valuation), revenue_summary(revenue).select("instrument_id", "last_yoy"))
    return enrich(rows, metrics.withColumnRenamed("instrument_id", "peer_id"), "peer_id")
