"""Named queries and, where SQL can say it, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landing import MarketTables
from .oracle_tables import oracle

Plan = Callable[[MarketTables], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, **tables: str) -> Callable[[Plan], Plan]:
    """Register a plan; ``body`` is the oracle over the derived tables, ``tables`` its extra CTEs."""

    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = plan
        if body is not None:
            ORACLES[name] = oracle(body, **tables)
        return plan

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded at the very end: sums of prices may be added in any order."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def load() -> None:
    """Import every plan module."""
    from . import all_plans  # noqa: F401
