"""Broker queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import Broker
from ..operators import brokers
from ..sources import normalize
from ..sources.landing import MarketTables
from .registry import query, rounded

# Five brokers per bar at most: two make a "top" that leaves some out.
TOP = 2
P = Broker(top=TOP, min_ops=10, hot=26, mid=25, long=24)

FOLLOW = {
    "b_top": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, date ORDER BY net DESC, broker) AS rk
                FROM d_broker WHERE net > 0) WHERE rk <= {TOP}""",
    "b_follow": """SELECT b.instrument_id, b.broker, b.date AS buy_date, c.next_date AS sell_date, b.net AS bought,
            CAST(coalesce(a.net, 0) < 0 AS BIGINT) AS flip,
            CASE WHEN a.net < 0 THEN least(b.net, -a.net) ELSE 0e0 END AS dumped
        FROM b_top b JOIN d_cal c ON b.date = c.date
        JOIN (SELECT DISTINCT instrument_id, date FROM d_broker) d ON d.instrument_id = b.instrument_id AND d.date = c.next_date
        LEFT JOIN d_broker a ON a.instrument_id = b.instrument_id AND a.date = c.next_date AND a.broker = b.broker""",
    "b_profile": """SELECT broker, ops, flips, round(100.0 * flips / ops, 1) AS flip_rate,
            CASE WHEN bought > 0 THEN round(dumped / bought * 100, 1) ELSE 0 END AS dump_ratio, n_instruments,
            CASE WHEN round(100.0 * flips / ops, 1) >= 26 THEN 'hot' WHEN round(100.0 * flips / ops, 1) >= 25 THEN 'mid'
                 WHEN round(100.0 * flips / ops, 1) < 24 THEN 'long' ELSE 'neutral' END AS broker_class
        FROM (SELECT broker, count(*) AS ops, CAST(sum(flip) AS BIGINT) AS flips, sum(bought) AS bought, sum(dumped) AS dumped,
                     count(DISTINCT instrument_id) AS n_instruments FROM b_follow GROUP BY broker) WHERE ops >= 10""",
    "b_main": f"""SELECT instrument_id, date,
            sum(CASE WHEN (b <= {TOP} AND net > 0) OR (s <= {TOP} AND net < 0) THEN net ELSE 0e0 END) AS main_net,
            sum(CASE WHEN b <= {TOP} AND net > 0 THEN net ELSE 0e0 END) AS main_buy,
            sum(CASE WHEN s <= {TOP} AND net < 0 THEN net ELSE 0e0 END) AS main_sell,
            count(*) FILTER (WHERE b <= {TOP} AND net > 0) AS n_buyers, count(*) FILTER (WHERE s <= {TOP} AND net < 0) AS n_sellers
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, date ORDER BY net DESC, broker) AS b,
                row_number() OVER (PARTITION BY instrument_id, date ORDER BY net, broker DESC) AS s FROM d_broker) GROUP BY instrument_id, date""",
    "b_flip": """SELECT s.instrument_id, s.date, coalesce(overlap, 0) AS overlap, coalesce(overlap, 0) / volume * 100 AS flip_pressure_pct
        FROM (SELECT DISTINCT t.instrument_id, t.date FROM d_broker t JOIN d_cal c ON c.date = t.date JOIN d_broker y ON y.instrument_id = t.instrument_id AND y.date = c.prev_date) s
        JOIN d_bars b ON b.instrument_id = s.instrument_id AND b.date = s.date
        LEFT JOIN (SELECT instrument_id, sell_date AS date, sum(dumped) AS overlap FROM b_follow GROUP BY ALL) o ON o.instrument_id = s.instrument_id AND o.date = s.date WHERE volume > 0""",
    "b_expected": """SELECT e.instrument_id, e.date, lots AS expected_lots, n_flippers,
            CASE WHEN n_flippers = 0 THEN 0 WHEN volume > 0 THEN lots / volume * 100 END AS expected_pct
        FROM (SELECT d.instrument_id, d.date, sum(CASE WHEN flip_rate >= 25 THEN t.net * dump_ratio / 100 ELSE 0e0 END) AS lots,
                     count(*) FILTER (WHERE flip_rate >= 25) AS n_flippers
              FROM (SELECT DISTINCT instrument_id, date FROM d_broker) d LEFT JOIN b_top t ON t.instrument_id = d.instrument_id AND t.date = d.date
              LEFT JOIN b_profile USING (broker) WHERE (SELECT count(*) FROM b_profile) > 0 GROUP BY d.instrument_id, d.date) e
        LEFT JOIN d_bars b ON b.instrument_id = e.instrument_id AND b.date = e.date""",
    "b_flips": """SELECT b.instrument_id, b.broker, b.date, least(b.net, -a.net) AS dumped
        FROM b_wtop b JOIN (SELECT instrument_id, date, lead(date) OVER (PARTITION BY instrument_id ORDER BY date) AS nd
                            FROM (SELECT DISTINCT instrument_id, date FROM b_window)) d ON d.instrument_id = b.instrument_id AND d.date = b.date
        JOIN b_window a ON a.instrument_id = b.instrument_id AND a.date = d.nd AND a.broker = b.broker AND a.net < 0""",
    "b_window": "SELECT * FROM d_broker WHERE date IN (SELECT date FROM d_cal WHERE age <= 31)",
    "b_wtop": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, date ORDER BY net DESC, broker) AS rk
                FROM b_window WHERE net > 0) WHERE rk <= {TOP}""",
    "b_regulars": "SELECT instrument_id, broker, count(*) AS hits, sum(dumped) AS dumped FROM b_flips GROUP BY ALL HAVING count(*) >= 2",
}


def stored_profile(m: MarketTables) -> DataFrame:
    return m.broker_profile(P)


@query("broker_net_from_trades", "SELECT instrument_id, date, broker, net FROM d_broker")
def broker_net(m: MarketTables) -> DataFrame:
    return m.broker_net


@query("broker_map_round_trip", "SELECT instrument_id, date, broker, net FROM d_broker")
def broker_maps(m: MarketTables) -> DataFrame:
    return normalize.broker_rows(normalize.broker_maps(m.broker_net))


@query("broker_main_net", "SELECT * FROM b_main", **FOLLOW)
def main_net(m: MarketTables) -> DataFrame:
    return brokers.broker_main_net(m.broker_net, TOP)


@query("next_date_pairs", "SELECT instrument_id, broker, buy_date, sell_date, bought, flip, dumped FROM b_follow", **FOLLOW)
def follow_up(m: MarketTables) -> DataFrame:
    return brokers.buyer_follow_up(m.broker_net, m.calendar, TOP)


@query("flip_pressure", "SELECT instrument_id, date, overlap, round(flip_pressure_pct, 6) AS flip_pressure_pct FROM b_flip", **FOLLOW)
def flip_pressure(m: MarketTables) -> DataFrame:
    return rounded(brokers.flip_pressure(m.broker_net, m.bars, m.calendar, TOP), "flip_pressure_pct")


@query("broker_profile", "SELECT * FROM b_profile", **FOLLOW)
def profile(m: MarketTables) -> DataFrame:
    return brokers.broker_profile(m.broker_net, m.calendar, P)


@query(
    "broker_profile_before", "SELECT * FROM b_profile",
    **{**FOLLOW, "b_profile": FOLLOW["b_profile"].replace("FROM b_follow GROUP", "FROM b_follow WHERE sell_date < DATE '1999-01-04' GROUP")},
)
def profile_before(m: MarketTables) -> DataFrame:
    return brokers.broker_profile(m.broker_net, m.calendar, P, before="1999-01-04")


@query(
    "expected_pressure",
    "SELECT instrument_id, date, round(expected_lots, 6) AS expected_lots, n_flippers, round(expected_pct, 6) AS expected_pct FROM b_expected",
    **FOLLOW,
)
def expected(m: MarketTables) -> DataFrame:
    return rounded(brokers.expected_pressure(m.broker_net, stored_profile(m), m.bars, P), "expected_lots", "expected_pct")


@query("flip_regulars", "SELECT instrument_id, broker, hits, dumped FROM b_regulars", **FOLLOW)
def regulars(m: MarketTables) -> DataFrame:
    return brokers.flip_regulars(m.broker_net, m.calendar, lookback=30, top=TOP)


@query(
    "top_branches",
    """SELECT instrument_id, date, side, CAST(rk AS INTEGER) AS rank, broker, net, flip_rate, ops, broker_class FROM (
         SELECT *, 'buy' AS side FROM b_top UNION ALL
         SELECT *, 'sell' AS side FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, date ORDER BY net, broker) AS rk
                                        FROM d_broker WHERE net < 0) WHERE rk <= 2) LEFT JOIN b_profile USING (broker)""",
    **FOLLOW,
)
def branches(m: MarketTables) -> DataFrame:
    return brokers.top_branches(m.broker_net, stored_profile(m), TOP)


@query(
    "profile_listing",
    """SELECT * EXCLUDE rk, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY broker_class
         ORDER BY CASE WHEN broker_class = 'long' THEN flip_rate ELSE -flip_rate END, ops DESC, broker) AS rk FROM b_profile) WHERE rk <= 2""",
    **FOLLOW,
)
def listing(m: MarketTables) -> DataFrame:
    return brokers.profile_listing(brokers.broker_profile(m.broker_net, m.calendar, P), 2)


@query(
    "broker_timeline",
    "SELECT instrument_id, date, main_net, round(flip_pressure_pct, 6) AS flip_pressure_pct FROM b_main LEFT JOIN b_flip USING (instrument_id, date)",
    **FOLLOW,
)
def timeline(m: MarketTables) -> DataFrame:
    return rounded(brokers.broker_timeline(m.broker_net, m.bars, m.calendar, TOP), "flip_pressure_pct")


PIT = {
    "b_daily": """SELECT broker, sell_date AS date, count(*) AS ops, sum(flip) AS flips, sum(bought) AS bought, sum(dumped) AS dumped
        FROM b_follow GROUP BY ALL""",
    "b_pit": """SELECT c.date, d.broker, round(sum(flips) / sum(ops) * 100, 1) AS flip_rate,
            CASE WHEN sum(bought) > 0 THEN round(sum(dumped) / sum(bought) * 100, 1) ELSE 0 END AS dump_ratio
        FROM d_cal c JOIN b_daily d ON d.date < c.date GROUP BY ALL HAVING sum(ops) >= 10""",
    "b_pitx": """SELECT e.instrument_id, e.date, lots AS expected_lots, n_flippers,
            CASE WHEN n_flippers = 0 THEN 0 WHEN volume > 0 THEN lots / volume * 100 END AS expected_pct
        FROM (SELECT d.instrument_id, d.date, sum(CASE WHEN flip_rate >= 25 THEN t.net * dump_ratio / 100 ELSE 0e0 END) AS lots,
                     count(*) FILTER (WHERE flip_rate >= 25) AS n_flippers
              FROM (SELECT DISTINCT instrument_id, date FROM d_broker) d LEFT JOIN b_top t ON t.instrument_id = d.instrument_id AND t.date = d.date
              LEFT JOIN b_pit p ON p.broker = t.broker AND p.date = t.date WHERE d.date IN (SELECT date FROM b_pit) GROUP BY d.instrument_id, d.date) e
        LEFT JOIN d_bars b ON b.instrument_id = e.instrument_id AND b.date = e.date""",
}


@query(
    "pit_expected_pressure",
    "SELECT instrument_id, date, round(expected_lots, 6) AS expected_lots, n_flippers, round(expected_pct, 6) AS expected_pct FROM b_pitx",
    **FOLLOW, **PIT,
)
def pit(m: MarketTables) -> DataFrame:
    out = brokers.pit_expected_pressure(m.broker_net, m.bars, m.calendar, P, m.broker_history(P))
    return rounded(out, "expected_lots", "expected_pct")


@query(
    "profile_history",
    """SELECT broker, date, CAST(sum(ops) OVER w AS BIGINT) AS ops, CAST(sum(flips) OVER w AS BIGINT) AS flips, sum(bought) OVER w AS bought,
          sum(dumped) OVER w AS dumped, CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS n_instruments
       FROM b_daily LEFT JOIN (SELECT broker, date, count(*) AS n FROM (SELECT broker, instrument_id, min(sell_date) AS date FROM b_follow GROUP BY ALL) GROUP BY ALL) USING (broker, date)
       WINDOW w AS (PARTITION BY broker ORDER BY date)""",
    **FOLLOW, **PIT,
)
def history(m: MarketTables) -> DataFrame:
    return brokers.profile_history(m.broker_net, m.calendar, P)


