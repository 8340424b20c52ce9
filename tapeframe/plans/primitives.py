"""The generic building blocks, each on the whole panel, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import windows as fw
from ..functions.quantiles import exact_median, quantile_bins, rank_bins
from ..operators import evaluate as ev
from ..operators import fundamentals as fund
from ..operators import report, screens, sets, study
from ..sources import normalize
from ..sources.landing import MarketTables
from . import screens as ps
from .registry import query, rounded

W = "WINDOW w AS (PARTITION BY instrument_id ORDER BY date)"


def frame(n: int, name: str = "f") -> str:
    return f"{name} AS (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "window_changes",
    f"""SELECT instrument_id, date, round(close - lag(close) OVER w, 6) + 0e0 AS diff, round(close / lag(close) OVER w - 1, 6) + 0e0 AS ret_1,
          round(close / lag(close, 10) OVER w - 1, 6) + 0e0 AS ret_10 FROM d_bars {W}""",
)
def window_changes(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    out = m.bars.select("instrument_id", "date", fw.diff("close", w).alias("diff"), fw.return_n("close", w).alias("ret_1"), fw.return_n("close", w, 10).alias("ret_10"))
    return rounded(out, "diff", "ret_1", "ret_10")


@query(
    "rolling_stats",
    f"""SELECT instrument_id, date, sum(volume) OVER f AS vol_sum, round(avg(close) OVER f, 6) AS close_mean, max(high) OVER f AS hi, min(low) OVER f AS lo,
          CAST(sum(CASE WHEN inst_net > 0 THEN 1 ELSE 0 END) OVER f AS BIGINT) AS buy_days FROM d_flow WINDOW {frame(20)}""",
)
def rolling_stats(m: MarketTables) -> DataFrame:
    f = fw.trailing(fw.ordered("instrument_id"), 20)
    out = m.flow_panel.select(
        "instrument_id", "date", F.sum("volume").over(f).alias("vol_sum"), F.avg("close").over(f).alias("close_mean"), F.max("high").over(f).alias("hi"),
        F.min("low").over(f).alias("lo"), F.sum(F.when(F.col("inst_net") > 0, 1).otherwise(0)).over(f).alias("buy_days"),
    )
    return rounded(out, "close_mean")


@query(
    "rolling_volatility",
    f"""SELECT instrument_id, date, round(stddev_pop(r) OVER f, 6) AS sigma FROM (SELECT instrument_id, date, coalesce(close / lag(close) OVER w - 1, 0) AS r FROM d_bars {W}) WINDOW {frame(20)}""",
)
def rolling_volatility(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    r = m.bars.select("instrument_id", "date", F.coalesce(fw.return_n("close", w), F.lit(0.0)).alias("r"))
    return rounded(r.select("instrument_id", "date", fw.volatility("r", w, 20).alias("sigma")), "sigma")


@query(
    "true_range_atr",
    f"""SELECT instrument_id, date, round(tr, 6) AS tr, round(CASE WHEN count(*) OVER f = 14 THEN avg(tr) OVER f END, 6) AS atr FROM
        (SELECT instrument_id, date, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM d_bars {W}) WINDOW {frame(14)}""",
)
def true_range_atr(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    tr = m.bars.select("instrument_id", "date", fw.true_range(w).alias("tr"))
    return rounded(tr.withColumn("atr", fw.sma("tr", w, 14)), "tr", "atr")


@query(
    "sliding_range", f"SELECT instrument_id, date, max(high) OVER f AS hi, min(high) OVER f AS lo FROM d_bars WINDOW {frame(20)}",
)
def sliding_range(m: MarketTables) -> DataFrame:
    return fw.with_sliding_range(m.bars.select("instrument_id", "date", "high"), "high", 20, "hi", "lo").drop("high")


@query("drawdown", f"SELECT instrument_id, date, max(close) OVER w AS peak, round(close / max(close) OVER w - 1, 6) + 0e0 AS drawdown FROM d_bars {W}")
def drawdown(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    out = m.bars.select("instrument_id", "date", fw.running_max("close", w).alias("peak"), fw.drawdown("close", w).alias("drawdown"))
    return rounded(out, "drawdown")


@query("normalised_series", f"SELECT instrument_id, date, round(close / first_value(close) OVER w, 6) AS norm FROM d_bars {W}")
def normalised(m: MarketTables) -> DataFrame:
    return rounded(m.bars.select("instrument_id", "date", fw.normalised("close", fw.ordered("instrument_id")).alias("norm")), "norm")


@query(
    "cumulative_growth",
    f"SELECT instrument_id, date, round(sum(ln(1 + coalesce(close / lag_close - 1, 0))) OVER w, 6) + 0e0 AS log_growth FROM (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY date) AS lag_close FROM d_bars) {W}",
)
def cumulative_growth(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    r = m.bars.select("instrument_id", "date", F.coalesce(fw.return_n("close", w), F.lit(0.0)).alias("r"))
    return rounded(r.select("instrument_id", "date", F.log(fw.cumulative_growth("r", w)).alias("log_growth")), "log_growth")


@query(
    "buy_streak",
    """SELECT instrument_id, date, CAST(row_number() OVER (PARTITION BY instrument_id, island ORDER BY date) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS INTEGER) AS streak
       FROM (SELECT *, sum(CASE WHEN inst_net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY date) AS island FROM d_flow)""",
)
def buy_streak(m: MarketTables) -> DataFrame:
    return m.flow_panel.select("instrument_id", "date", fw.buy_streak("inst_net", fw.ordered("instrument_id")).alias("streak"))


@query(
    "latest_streaks",
    """SELECT instrument_id, CAST(s0 * (coalesce(min(CASE WHEN s = 0 OR s <> s0 THEN k END), max(k) + 1) - 1) AS BIGINT) AS streak FROM
       (SELECT instrument_id, sign(total_net) AS s, first_value(sign(total_net)) OVER d AS s0, row_number() OVER d AS k FROM d_inst WINDOW d AS (PARTITION BY instrument_id ORDER BY date DESC)) GROUP BY instrument_id, s0""",
)
def latest_streaks(m: MarketTables) -> DataFrame:
    return fw.latest_streaks(m.institutional, "instrument_id", {"total_net": "streak"})


@query(
    "latest_streaks_by_block",
    """SELECT instrument_id, CAST(s0 * (coalesce(min(CASE WHEN s = 0 OR s <> s0 THEN k END), max(k) + 1) - 1) AS BIGINT) AS streak FROM
       (SELECT instrument_id, sign(total_net) AS s, first_value(sign(total_net)) OVER d AS s0, row_number() OVER d AS k FROM d_inst WINDOW d AS (PARTITION BY instrument_id ORDER BY date DESC)) GROUP BY instrument_id, s0""",
)
def streaks_by_block(m: MarketTables) -> DataFrame:
    return fw.deepening_streaks(m.institutional, m.calendar, m.instruments, {"total_net": "streak"})


@query(
    "range_position",
    f"""SELECT instrument_id, date, round(CASE WHEN count(*) OVER f >= 120 AND max(close) OVER f > min(close) OVER f THEN (close - min(close) OVER f) / (max(close) OVER f - min(close) OVER f) * 100 END, 6) AS position
        FROM d_bars WINDOW {frame(240)}""",
)
def range_position(m: MarketTables) -> DataFrame:
    out = fw.with_range_position(m.bars.select("instrument_id", "date", "close"), "close", 240, 120, "position")
    return rounded(out.drop("close"), "position")


@query(
    "forward_returns",
    f"""SELECT instrument_id, date, round((lead(open) OVER w - close) / close * 100, 6) + 0e0 AS gap, round((lead(close) OVER w - lead(open) OVER w) / lead(open) OVER w * 100, 6) + 0e0 AS oc,
          round((lead(close) OVER w - close) / close * 100, 6) + 0e0 AS cc FROM d_bars {W}""",
)
def forward_returns(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    o, c = F.lead("open").over(w), F.lead("close").over(w)
    out = m.bars.select("instrument_id", "date", fc.pct_simple(o, "close").alias("gap"), fc.pct_simple(c, o).alias("oc"), fc.pct_simple(c, "close").alias("cc"))
    return rounded(out, "gap", "oc", "cc")


@query("revenue_year_to_date", "SELECT instrument_id, year, month, revenue, prior, round(cum, 4) AS cum, round(cum_prior, 4) AS cum_prior, CAST(n_prior AS INTEGER) AS n_prior FROM d_revcum")
def revenue_ytd(m: MarketTables) -> DataFrame:
    return rounded(fund.revenue_year_to_date(m.revenue), "cum", "cum_prior", digits=4)


@query("cross_section_median", "SELECT date, round(median(close), 6) AS median FROM d_bars GROUP BY date")
def median(m: MarketTables) -> DataFrame:
    return rounded(exact_median(m.bars, "close", ["date"]), "median")


@query(
    "advance_decline",
    f"""SELECT date, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, count(*) FILTER (WHERE d = 0) AS flat, round(avg(CASE WHEN d > 0 THEN 1e0 ELSE 0e0 END), 6) AS up_share
        FROM (SELECT date, close - lag(close) OVER w AS d FROM d_bars {W}) WHERE d IS NOT NULL GROUP BY date""",
)
def advance_decline(m: MarketTables) -> DataFrame:
    d = m.bars.select("date", fw.diff("close", fw.ordered("instrument_id")).alias("d")).filter("d is not null")
    out = d.groupBy("date").agg(
        F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("flat"),
        F.avg((F.col("d") > 0).cast("double")).alias("up_share"),
    )
    return rounded(out, "up_share")


@query(
    "quantile_bins",
    """SELECT instrument_id, date, volume, CAST(len(list_filter(list_sort(e)[2:], lambda x: x < volume)) + 1 AS INTEGER) AS bin
       FROM d_bars, (SELECT list_distinct(quantile_cont(volume, [0, 0.25, 0.5, 0.75, 1])) AS e FROM d_bars)""",
)
def quantile(m: MarketTables) -> DataFrame:
    return quantile_bins(m.bars.select("instrument_id", "date", "volume"), "volume", 4)


@query(
    "rank_bins",
    """SELECT instrument_id, date, k AS rank, CAST(greatest(1, ceil((k - 1) * 5 / (n - 1))) AS INTEGER) AS bin FROM
       (SELECT instrument_id, date, row_number() OVER (ORDER BY volume, date, instrument_id) AS k, count(*) OVER () AS n FROM d_bars)""",
)
def ranks(m: MarketTables) -> DataFrame:
    return rank_bins(m.bars.select("instrument_id", "date", "volume"), 5, "volume", "date", "instrument_id").drop("volume")


@query(
    "factor_buckets_return",
    """SELECT bin, count(*) AS n, round(avg(dt), 6) AS factor_mean, round(avg(cc), 6) AS outcome_mean, round(avg(CASE WHEN cc < 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS below_zero_pct, round(median(dt), 6) AS factor_median
       FROM (SELECT dt, cc, CAST(greatest(1, ceil((k - 1) * 4 / (n - 1))) AS INTEGER) AS bin FROM
         (SELECT *, row_number() OVER (ORDER BY dt, instrument_id, date) AS k, count(*) OVER () AS n FROM fb)) GROUP BY bin""",
    fb="SELECT * FROM (SELECT instrument_id, date, dt_vol / volume * 100 AS dt, (lead(close) OVER (PARTITION BY instrument_id ORDER BY date) - close) / close * 100 AS cc FROM d_panel) WHERE cc IS NOT NULL AND dt IS NOT NULL",
)
def factor_buckets(m: MarketTables) -> DataFrame:
    w = fw.ordered("instrument_id")
    panel = m.panel.select("instrument_id", "date", (fc.ratio("dt_vol", "volume") * 100).alias("dt"), fc.pct_simple(F.lead("close").over(w), "close").alias("cc"))
    out = study.factor_buckets(panel, "dt", "cc", 4)
    return rounded(out, "factor_mean", "outcome_mean", "below_zero_pct", "factor_median")


@query(
    "round_trip_return",
    "SELECT instrument_id, date, round(close / open * ((1 - 0.004425e0) / (1 + 0.001425e0)) - 1, 6) + 0e0 AS ret FROM d_bars",
)
def round_trip(m: MarketTables) -> DataFrame:
    return rounded(m.bars.select("instrument_id", "date", fc.round_trip_return("open", "close").alias("ret")), "ret")


@query(
    "scalar_functions",
    """SELECT instrument_id, date, greatest(least(inst_net, 20e0), -20e0) AS clipped, CASE WHEN inst_net > 10 THEN 1 WHEN inst_net < -10 THEN -1 ELSE 0 END AS vote,
          CAST(trunc(inst_net * 337 / 1000) AS BIGINT) AS lots, CAST(round_even(inst_net * 337 / 1000, 0) AS BIGINT) AS lots_rounded, inst_net / nullif(margin_balance - 100, 0) AS ratio,
          round(log10(greatest(volume, 10)), 6) AS log_volume FROM d_flow""",
)
def scalars(m: MarketTables) -> DataFrame:
    shares = F.col("inst_net") * 337
    return m.flow_panel.select(
        "instrument_id", "date", fc.clip("inst_net", -20, 20).alias("clipped"), fc.vote("inst_net", 10, -10).alias("vote"),
        fc.shares_to_lots(shares).alias("lots"), fc.shares_to_lots_rounded(shares).alias("lots_rounded"),
        fc.ratio("inst_net", F.col("margin_balance") - 100).alias("ratio"), F.round(F.log10(F.greatest("volume", F.lit(10.0))), 6).alias("log_volume"),
    )


def raw_quotes(m: MarketTables) -> DataFrame:
    """Landed text: local dates, thousands separators, shares; zero-volume codes padded in."""
    text = lambda c: F.format_number(c, 2)
    return m.bars.select(
        (F.col("instrument_id") + 1000).cast("string").alias("code"),
        F.concat(F.lpad((F.year("date") - fc.LOCAL_YEAR_OFFSET).cast("string"), 3, "0"), F.date_format("date", "/MM/dd")).alias("day"),
        text("open").alias("open"), text("high").alias("high"), text("low").alias("low"),
        F.when(F.col("volume") > 200, "--").otherwise(text("close")).alias("close"), F.format_number(F.col("volume") * 1437, 0).alias("shares"),
    )


@query(
    "normalize_quotes",
    """SELECT CAST(instrument_id + 1000 AS VARCHAR) AS instrument_id, date, open, high, low, CASE WHEN volume > 200 THEN 0 ELSE close END AS close, CAST(trunc(volume * 1437 / 1000) AS BIGINT) AS volume FROM d_bars""",
)
def normalize_quotes(m: MarketTables) -> DataFrame:
    return normalize.normalize_quotes(raw_quotes(m))


@query("common_instruments", "SELECT CAST(instrument_id + 950 AS VARCHAR) AS instrument_id FROM d_info WHERE instrument_id + 950 BETWEEN 1000 AND 9999")
def common_instruments(m: MarketTables) -> DataFrame:
    return normalize.common_instruments(m.instruments.select((F.col("instrument_id") + 950).cast("string").alias("instrument_id")))


@query(
    "normalize_flows",
    """SELECT CAST(instrument_id AS VARCHAR) AS instrument_id, date, CAST(trunc(foreign_net * 777 / 1000) AS BIGINT) AS foreign_net, CAST(trunc(trust_net * 777 / 1000) AS BIGINT) AS trust_net,
          CAST(trunc(dealer_net * 777 / 1000) AS BIGINT) AS dealer_net, CAST(trunc(total_net * 777 / 1000) AS BIGINT) AS total_net FROM d_inst""",
)
def normalize_flows(m: MarketTables) -> DataFrame:
    raw = m.institutional.select(
        F.col("instrument_id").cast("string").alias("code"),
        F.concat(F.lpad((F.year("date") - fc.LOCAL_YEAR_OFFSET).cast("string"), 3, "0"), F.date_format("date", "MMdd")).alias("day"),
        *[F.format_number(F.col(c) * 777, 0).alias(c) for c in ("foreign_net", "trust_net", "dealer_net", "total_net")],
    )
    return normalize.normalize_flows(raw)


@query(
    "normalize_balances",
    "SELECT CAST(instrument_id AS VARCHAR) AS instrument_id, date, CAST(round_even(sbl_balance * 777 / 1000, 0) AS BIGINT) AS sbl_balance FROM d_panel WHERE sbl_balance > 0",
)
def normalize_balances(m: MarketTables) -> DataFrame:
    raw = m.panel.select(
        F.col("instrument_id").cast("string").alias("code"),
        F.concat(F.lpad((F.year("date") - fc.LOCAL_YEAR_OFFSET).cast("string"), 3, "0"), F.date_format("date", "MMdd")).alias("day"),
        F.when(F.col("sbl_balance") > 0, F.format_number(F.col("sbl_balance") * 777, 0)).otherwise("").alias("shares"),
    )
    return normalize.normalize_balances(raw)


@query(
    "normalize_revenue",
    """SELECT CAST(instrument_id AS VARCHAR) AS instrument_id, year, month, round(revenue, 2) AS revenue,
          CASE WHEN month = 3 THEN make_date(year, 4, 7) ELSE CAST(make_date(year, month, 1) + INTERVAL 1 MONTH + INTERVAL 9 DAY AS DATE) END AS pub_date
       FROM (SELECT * REPLACE (floor(revenue) AS revenue) FROM d_rev)""",
)
def normalize_revenue(m: MarketTables) -> DataFrame:
    raw = m.revenue.select(
        F.col("instrument_id").cast("string").alias("code"), "year", "month", F.format_number(F.floor("revenue"), 0).alias("revenue"),
        F.when(F.col("month") == 3, F.concat(F.col("year").cast("string"), F.lit("-04-07 08:00:00"))).otherwise("").alias("created"),
    )
    return normalize.normalize_revenue(raw)


@query(
    "detail_map",
    "SELECT instrument_id, date, broker AS name, CAST(net AS BIGINT) AS lots FROM d_broker",
)
def detail_map(m: MarketTables) -> DataFrame:
    """Nets written as detail text and read back."""
    entry = F.concat("broker", F.lit("+"), F.col("net").cast("long").cast("string"))
    text = m.broker_net.groupBy("instrument_id", "date").agg(F.array_join(F.sort_array(F.collect_list(entry)), "、").alias("detail"))
    return text.select("instrument_id", "date", F.explode(fc.detail_map("detail")).alias("name", "lots"))


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(m: MarketTables) -> DataFrame:
    return m.raw("events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query(
    "double_signal",
    f"""SELECT instrument_id FROM (SELECT instrument_id FROM tech WHERE ma_align = 'bull') JOIN (SELECT instrument_id FROM tech WHERE long_term = 'above both') USING (instrument_id)""", tech=ps.TECH,
)
def double_signal(m: MarketTables) -> DataFrame:
    from ..operators.technical import tech_signals

    tech = tech_signals(m.bars)
    return sets.double_signal(tech.filter("ma_align = 'bull'"), tech.filter("long_term = 'above both'"))


@query("soft_minus_strict", f"SELECT instrument_id FROM ({ps.ACCUM_BODY.format(streak=1)}) WHERE streak < 2", **ps.ACCUM_CTES)
def soft_minus_strict(m: MarketTables) -> DataFrame:
    return sets.soft_only(ps._accum(m, 1), ps._accum(m, 2)).select("instrument_id")


@query(
    "dedup_first",
    "SELECT instrument_id, date, broker FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, broker ORDER BY date) AS k FROM d_broker) WHERE k = 1",
)
def dedup_first(m: MarketTables) -> DataFrame:
    return sets.dedup_first(m.broker_net.select("instrument_id", "date", "broker"), ["instrument_id", "broker"], ["date"])


@query(
    "by_precedence",
    """SELECT instrument_id, src FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY p) AS k FROM
       (SELECT DISTINCT instrument_id, 'sbl' AS src, 0 AS p FROM d_sbl WHERE sbl_balance > 150 UNION ALL SELECT instrument_id, 'info', 1 FROM d_info)) WHERE k = 1""",
)
def by_precedence(m: MarketTables) -> DataFrame:
    a = m.sbl.filter("sbl_balance > 150").select("instrument_id", F.lit("sbl").alias("src")).distinct()
    return sets.by_precedence([a, m.instruments.select("instrument_id", F.lit("info").alias("src"))], "instrument_id")


@query(
    "ranked_union",
    "SELECT instrument_id, max(v) AS v FROM (SELECT instrument_id, dt_vol AS v FROM d_daytrade UNION ALL SELECT instrument_id, sbl_balance FROM d_sbl) GROUP BY 1 ORDER BY v DESC, instrument_id LIMIT 6",
)
def ranked_union(m: MarketTables) -> DataFrame:
    return sets.ranked_union([m.day_trade.withColumnRenamed("dt_vol", "v"), m.sbl.withColumnRenamed("sbl_balance", "v")], "instrument_id", "v", 6)


@query("relabel", 'SELECT instrument_id AS "Code", instrument_name AS "Name", industry, type FROM d_info')
def relabel(m: MarketTables) -> DataFrame:
    return sets.relabel(m.instruments, {"instrument_id": "Code", "instrument_name": "Name", "absent": "Absent"})


@query(
    "pack_windows",
    f"""SELECT a.instrument_id, concat_ws(' / ', CAST(CAST(a.foreign_net AS BIGINT) AS VARCHAR), CAST(CAST(b.foreign_net AS BIGINT) AS VARCHAR)) AS foreign_text
        FROM ({ps.flow_window_sql(10)}) a JOIN ({ps.flow_window_sql(20)}) b USING (instrument_id)""",
)
def pack_windows(m: MarketTables) -> DataFrame:
    from ..operators.flows import flow_windows

    both = flow_windows(m.institutional, m.margin, 10, "_10").join(flow_windows(m.institutional, m.margin, 20, "_20"), "instrument_id")
    return report.pack_windows(both, ["foreign_net_10", "foreign_net_20"], "foreign_text").select("instrument_id", "foreign_text")


@query(
    "capped_category",
    """SELECT instrument_id, close FROM (SELECT b.instrument_id, close, type = 'tpex' AS f, row_number() OVER (PARTITION BY type ORDER BY close DESC, instrument_id) AS k
       FROM d_bars b JOIN d_info USING (instrument_id) WHERE date = (SELECT max(date) FROM d_cal)) WHERE NOT f OR k <= 3""",
)
def capped_category(m: MarketTables) -> DataFrame:
    from ..sources.calendar import on_last_dates

    today = on_last_dates(m.bars, m.calendar, 1).join(m.instruments, "instrument_id").withColumn("f", F.col("type") == "tpex")
    return screens.capped_category(today, "f", "close", 3).select("instrument_id", "close")


@query(
    "best_by_key",
    """SELECT industry, instrument_id AS curve_id FROM (SELECT industry, instrument_id, row_number() OVER (PARTITION BY industry ORDER BY hi DESC, v DESC, instrument_id) AS k FROM
       (SELECT instrument_id, max(high) AS hi, sum(volume) AS v FROM d_bars GROUP BY instrument_id) JOIN d_info USING (instrument_id)) WHERE k = 1""",
)
def best_by(m: MarketTables) -> DataFrame:
    s = m.bars.groupBy("instrument_id").agg(F.max("high").alias("sharpe"), F.sum("volume").alias("cagr_pct")).join(m.instruments, "instrument_id")
    return ev.best_by(s.withColumnRenamed("instrument_id", "curve_id"), ["industry"]).select("industry", "curve_id")
