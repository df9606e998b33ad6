"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from the test tables and fully executed into Spark's ``noop``
sink (every row computed, nothing collected to the driver). A warm-up pass on the
smallest scale factor runs every query first, so code generation and JIT compilation are
not timed (plan building and optimisation still are). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from usagelens.plans.registry import QUERIES  # noqa: E402
from usagelens.session import local_session  # noqa: E402

HEADLINE = [
    "enhanced_history",
    "statement_cost",
    "node_cost_report",
    "node_cost_detail",
    "latest_schedules",
    "schedule_with_runs",
    "run_history",
    "run_stats",
    "timeline_run_stats",
    "dashboard_queries",
]
WARMUP_DIR = "/root/testdata/sf0.001"


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="usagelens-bench")
    if os.path.isdir(WARMUP_DIR) and WARMUP_DIR != sf_dir:
        for name in QUERIES:  # compiles every query's generated code once (cache is size-independent)
            run(spark, name, WARMUP_DIR)
    times = {name: round(run(spark, name, sf_dir), 3) for name in QUERIES}
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(times[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": times,
                "all_queries_sec": round(sum(times.values()), 3),
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
