"""Every registered query against its SQL oracle; at this scale none is empty."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tapeframe.plans import registry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle():
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    result = compare(con, entry.queries()[name](spark, SF), entry.oracle_sql()[name])
    assert result.startswith("ok") and "EMPTY" not in result, result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["date", "instrument_id", "ret", "market_ret", "score"]
