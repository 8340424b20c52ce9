"""Operator parameters.

Every default below is a fixed value that results depend on.  Callers override
them with keyword arguments; parameter sweeps pass them as data.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Accumulation:
    lookback: int = 10
    allowed_missing: int = 2
    min_streak: int = 4
    soft_streak: int = 3
    min_gain: float = -0.08
    max_gain: float = 0.12
    min_buy_ratio: float = 0.05
    max_margin_increase: float = 0.15
    max_above_ma20: float = 0.15
    min_avg_volume: float = 500
    min_avg_volume_tpex: float = 1000


@dataclass(frozen=True)
class Value:
    min_yield: float = 3.0
    max_per: float = 20.0
    max_pbr: float = 3.0
    min_roe: float = 5.0
    min_dividend_years: int = 5
    shortlist: int = 40
    max_lumpy: int = 3
    lumpy_industries: tuple[str, ...] = ("建材營造",)


@dataclass(frozen=True)
class DayTrade:
    lookback: int = 20
    min_rows: int = 10
    min_avg_volume: float = 5000
    min_avg_volume_tpex: float = 3000
    min_avg_amplitude: float = 4.5


@dataclass(frozen=True)
class RevenueMomentum:
    min_yoy: float = 30.0
    max_yoy: float = 300.0
    min_cum: float = 10.0
    max_cum: float = 200.0
    min_accel: float = 5.0
    min_close: float = 10.0
    min_avg_volume: float = 500
    cap_yoy: float = 150.0
    cap_cum: float = 100.0
    cap_accel: float = 100.0
    ma_bonus: float = 10.0
    exclude_industries: tuple[str, ...] = ("建材營造", "營建")


@dataclass(frozen=True)
class MainForce:
    lookback: int = 10
    min_close: float = 10.0
    min_avg_volume: float = 500
    w_inst: float = 2.0
    w_holder: float = 3.0
    w_margin: float = 1.0
    branch_top: int = 10


@dataclass(frozen=True)
class Landmine:
    revenue_bad: float = -20.0
    revenue_crash: float = -30.0
    eps_drop: float = -50.0
    margin_drop: float = 5.0
    sell_days: int = 4
    holder_drop: float = 1.0
    margin_surge: float = 0.20
    ma_long: int = 60
    weak_vs_market: float = -10.0
    lookback: int = 20
    severe: int = 6
    high: int = 4
    mid: int = 2


@dataclass(frozen=True)
class RelativeStrength:
    lookback: int = 10
    min_return: float = 0.0
    max_return: float = 0.30
    min_avg_volume: float = 500
    min_avg_volume_tpex: float = 1000


@dataclass(frozen=True)
class QuietAccumulation:
    window: int = 20
    buy_ratio: float = 0.02
    min_days: int = 10
    min_return: float = -0.08
    max_return: float = 0.08
    ma_dev: float = 0.05
    volume_squeeze: float = 1.0
    max_position: float = 60.0
    year_rows: int = 240


@dataclass(frozen=True)
class Broker:
    top: int = 15
    min_ops: int = 10
    hot: float = 65
    mid: float = 50
    long: float = 30


@dataclass(frozen=True)
class LockScreen:
    min_gain: float = 9.0
    top_n: int = 15
    lookback: int = 8
    min_hits: int = 2
    detail_top: int = 6


@dataclass(frozen=True)
class Costs:
    fee: float = 0.001425
    tax: float = 0.003
    discount: float = 1.0

    @property
    def buy(self) -> float:
        return self.fee * self.discount

    @property
    def sell(self) -> float:
        return self.fee * self.discount + self.tax


COSTS = Costs()
PERIODS_PER_YEAR = 252
LOT_SHARES = 1000
MAX_STALE_DAYS = 5
