"""Time the headline queries and print one JSON line.

Each query runs once untimed at the same scale (class loading, code generation), then
``BENCH_RUNS`` times; the best run counts. Results go to Spark's no-op sink, so every row and
column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from emberlog.catalog import QUERIES

HEADLINE = (
    "sessions", "sessions_multi_source", "stats_by_type", "stats_by_stage", "message_stats",
    "search_topn", "search_multi_source", "search_e2e", "search_batch", "filter_combined",
    "query_group", "scan_events", "append_roundtrip", "norm_cloud", "norm_pods",
    "lines_from_chunks", "redact_message", "redact_data", "trim_around_match", "output_guard",
    "sessions_topk", "stats_by_level", "stats_multi_source", "tail", "filter_contains",
    "ingest_bodies", "project_json", "format_template",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberlog-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(min(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
