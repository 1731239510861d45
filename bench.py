"""Headline queries at one scale; prints one JSON line with seconds per query.

Each query runs once to warm up; the reported time is the median of three further runs, from
declaring the plan to the last row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from incidentlens.plans import catalog
from incidentlens.session import configure

HEADLINE = [
    "request_evidence", "recent_logs", "scan_log_table", "redact_documents", "normalize_messages", "multiline_documents",
    "parse_heads", "multiline_log_events", "spikes", "log_clusters", "deployment_regression", "pool_contention",
    "slow_sql_rollup", "health_status", "mysql_digest", "validate_requests", "ingest_changes", "score_reports",
    "timeline", "diagnose_candidates", "reports",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        configure(SparkSession.builder).master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
