"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8), executing the full plan through the
``noop`` sink (no driver-side collect), best of ``$BENCH_REPEAT`` (default 2)
runs after one warm-up pass on the smallest data set. Files a query derives
for itself (the CSV export) are re-derived in every timed run. Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "incidents", "box_agg", "stage_counts", "profile_ranges", "count_by_dow_num", "box_date_stats",
    "box_date_stats_compat", "profile_cube", "train_profile", "train_test_split", "confusion_matrix", "macro_metrics",
    "train_tree", "tree_metrics", "score_requests", "mean_risk", "heatmap_layout",
    "csv_scan", "cell_type_profile", "csv_roundtrip", "parquet_roundtrip",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from georisk.queries import QUERIES
    from georisk.session import build_session, scale_conf

    input_bytes = sum(os.path.getsize(os.path.join(sf_dir, f)) for f in os.listdir(sf_dir))
    conf = scale_conf(input_bytes, cpus)
    if os.environ.get("BENCH_SPLIT_BYTES"):
        conf["spark.sql.files.maxPartitionBytes"] = os.environ["BENCH_SPLIT_BYTES"]
    spark = build_session(f"local[{cpus}]", extra={"spark.driver.memory": "8g", **conf})
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):  # steady state: generated code compiled and JIT-warmed once
        for name in [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE:
            run(QUERIES[name](spark, warm))

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "headline_total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
