"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  ``prepare`` is the
one pass over the facts that stores the base tables; the queries then read those.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tapeframe.plans import registry
from tapeframe.plans.brokers import P
from tapeframe.session import build_session
from tapeframe.sources.landing import MarketTables

HEADLINES = (
    "relative_strength_signals", "accumulation_signals", "quiet_accumulation_signals", "revenue_momentum_signals", "regime_gate",
    "accumulation_screen", "relative_strength_screen", "main_force_score", "limit_up_lock_screen", "chip_signals", "tech_signals",
    "landmine_flags", "financial_health", "broker_profile", "pit_expected_pressure", "pressure_study", "factor_buckets_return",
    "signal_trades", "curve_metrics", "grid_walk_forward", "strategy_compare", "daily_report_table",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINES)
    registry.load()
    spark = build_session(
        f"local[{cpus}]", "tapeframe-bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tapeframe-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = MarketTables(spark, sf)
    times: dict[str, float] = {}

    def run(name: str, action) -> None:
        start = time.time()
        action()
        times[name] = round(time.time() - start, 3)
        print(f"{name:32s} {times[name]:8.2f}", file=sys.stderr, flush=True)

    run("prepare", lambda: tables.prepare(P))
    for name in names:
        run(name, lambda n=name: registry.QUERIES[n](tables).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
