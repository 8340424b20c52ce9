from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tapeframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "local[4]", "tapeframe-tests",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def days(n: int, start: date = date(2024, 1, 1)) -> list[date]:
    return [start + timedelta(days=i) for i in range(n)]


@pytest.fixture
def frame(spark):
    def make(schema: str, *rows: tuple):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture
def bars(frame):
    """Bars from closes per instrument: open = high = low = close unless given as 4-tuples."""

    def make(series: dict, volume: float = 1000.0):
        rows = []
        for sid, values in series.items():
            for d, v in zip(days(len(values)), values):
                if v is None:
                    continue
                o, h, low, c = v if isinstance(v, tuple) else (v, v, v, v)
                rows.append((sid, d, float(o), float(h), float(low), float(c), volume))
        return frame("instrument_id long, date date, open double, high double, low double, close double, volume double", *rows)

    return make
