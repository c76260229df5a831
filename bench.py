"""Time the headline queries on the given tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordforge.plans import load  # noqa: E402
from recordforge.session import build_session  # noqa: E402

HEADLINE = [
    "random_walk_outcomes",
    "unit_permutations",
    "unit_repeat",
    "unit_chunks",
    "fan_out_lines",
    "derive_errors",
    "random_draws",
    "json_repair",
    "schema_check",
    "schema_nested",
    "rule_check",
    "step_validation",
    "vendor_results_openai",
    "ledger_unresolved",
    "ledger_retries",
    "verify_run",
    "repair_run",
    "funnel",
    "count_distribution",
    "numeric_stats",
    "top_errors",
    "compare_units",
    "run_costs",
    "run_summary",
    "cost_cap",
    "error_streaks",
    "stream_throughput",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
            "spark.sql.files.minPartitionNum": cpus,
            # The tables come in one part each, which is one task for work on rows.
            "spark.recordforge.tasks": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    queries["count_distribution"](spark, sf_dir).count()  # start the JVM paths once
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
