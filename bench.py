"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run once to warm up, then three times into the noop sink; the median counts."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lodestone.plans import registry
from lodestone.session import create_session

HEADLINE = [f"tpch_q{k:02d}" for k in range(1, 23)] + ["agg_hash", "agg_count_distinct", "join_semi", "join_equi_residual", "distinct_on", "win_running_sum", "topn", "vec_knn", "scan_csv_roundtrip"]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = create_session(f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        times = []
        for turn in range(4):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if turn:
                times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
