"""Write PLANS.md: per registered query, what its physical plan does.

Usage: python -u scripts/plan_report.py [--sf-dir DIR] > PLANS.md
Counts table scans, shuffle exchanges, broadcast exchanges, sorts and Python
evaluation nodes in the physical plan (before AQE's run-time changes).
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["lineitem", "events", "documents"]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    from georisk.plans.inspect import plan_text
    from georisk.queries import ORACLES, QUERIES
    from georisk.session import build_session
    spark = build_session("local[8]", 8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py` on `{a.sf_dir}` (physical plans as planned before AQE's run-time re-optimization, which may coalesce partitions or"
          " switch a join to broadcast; shapes do not depend on"
          " the scale). Scans count Parquet/CSV/text file scans of driver tables and of files the query"
          " wrote; `ckpt` = reads of a checkpointed table. Shuffle = hash/range/single-partition exchanges"
          " (AQE may coalesce their partitions); broadcast sides are bounded by the grid (see README).\n")
    print("| query | oracle | scans | ckpt | shuffles | broadcasts | sorts | python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        df = fn(spark, a.sf_dir)
        df.write.format("noop").mode("overwrite").save()
        p = plan_text(df, "simple")
        scans = {t: len(re.findall(rf"{t}\.parquet", p)) for t in TABLES}
        files = len(re.findall(r"FileScan (csv|text|parquet)", p)) - sum(scans.values())
        scan_s = ", ".join(f"{t}×{n}" for t, n in scans.items() if n)
        if files:
            scan_s = ", ".join(x for x in [scan_s, f"written files×{files}"] if x)
        ckpt = len(re.findall(r"Scan ExistingRDD|LogicalRDD", p))
        shuf = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p))
        bc = len(re.findall(r"BroadcastExchange", p))
        sorts = len(re.findall(r"\bSort \[", p))
        py = "yes" if re.search(r"BatchEvalPython|ArrowEvalPython|InPandas", p) else "no"
        print(f"| `{name}` | {'SQL' if name in ORACLES else 'rows'} | {scan_s or '-'} | {ckpt} | {shuf} | {bc} "
              f"| {sorts} | {py} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
