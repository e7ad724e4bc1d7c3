"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected), ``BENCH_RUNS`` times (default 3), and the
median is reported.  Every run is cold: before it Spark's cache is cleared
and the clusterings of earlier runs are deleted, so queries over clusters
are timed end to end, from the lines.  ``rca_27_lines`` is ``analyze`` over 27
lines, the size at which the baseline states a time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

RUNS = int(os.environ.get("BENCH_RUNS", "3"))  # median of N per query

HEADLINE = [
    "log_entries",
    "ingest_stats",
    "template_counts",
    "rca_results",
    "cluster_members",
    "prompt_table",
    "rca_resolved",
    "alerts",
    "sliding_template_counts",
    "dedupe_entries",
    "json_kv",
    "embed_sparse",
    "similar_pairs",
]


def few_lines(spark):
    """27 lines: nine messages, three times each."""
    words = ["link to store lost", "relay timed out", "heap close to full", "probe fine", "login refused", "old copy sent",
             "breaker is open", "job finished", "shard lagging"]
    rows = [("f", i + 1, f"2025-03-02 04:10:{i:02d} ERROR svc{i % 3} - {words[i % 9]} after {i} s") for i in range(27)]
    return spark.createDataFrame(rows, "source string, line_no bigint, raw_line string")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from logweave.plans import queries as Q
    from logweave.plans.analyze import analyze
    from logweave.session import get_spark

    scratch = tempfile.mkdtemp(prefix="logweave-bench-")
    spark = get_spark(
        f"local[{cpus}]",
        shuffle_partitions=int(cpus) * 2,
        extra={
            "spark.driver.memory": "16g", "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
            # Each table is one row group of a few MB, which splits can't cut.
            "spark.logweave.scanTasks": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(make) -> float:
        Q.forget_clusterings()
        spark.catalog.clearCache()
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm-up on the smallest tables (JIT, generated-code cache, Python
    # workers); the timed runs below read only ``sf_dir``.
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            run(lambda name=name: Q.QUERIES[name](spark, warm))

    times = {}
    for name in HEADLINE:
        times[name] = round(statistics.median(run(lambda name=name: Q.QUERIES[name](spark, sf_dir)) for _ in range(RUNS)), 3)
    # The same lines as a file of its own would have: one task for all.
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    lines = few_lines(spark).coalesce(1)
    few = round(statistics.median(run(lambda: analyze(lines)) for _ in range(RUNS + 2)), 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "log_lines": n,
        "rca_lines_per_sec": round(n / times["rca_results"], 1),
        "rca_27_lines": few,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
