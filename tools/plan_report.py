"""Physical-plan summary of every registered query (after adaptive execution).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffles, broadcast and sort-merge joins, window operators, Python
nodes and file scans in each query's final plan, plus the scan schemas of
the contest-table build (column pruning) and its pushed filters.
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duelframe.registry import QUERIES, order_stats  # noqa: E402
from duelframe.session import build_session  # noqa: E402

NODES = [("Exchange", r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)"),
         ("ReusedExchange", r"ReusedExchange"), ("BroadcastExchange", r"BroadcastExchange"),
         ("BroadcastHashJoin", r"BroadcastHashJoin"), ("SortMergeJoin", r"SortMergeJoin"),
         ("Window", r"\bWindow \["), ("HashAggregate", r"HashAggregate"),
         ("MapInPandas/Python", r"(MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython)"),
         ("Scan", r"(FileScan|Scan ExistingRDD|Scan parquet)")]


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    tracker = spark.sparkContext.statusTracker()
    print(f"# Physical plans that ran (final adaptive plans, {sf}, local[8])\n")
    print("Each query is collected, and the plan of that very execution is counted. `jobs` are the Spark jobs\n"
          "started while the DataFrame was built (stored tables, fits), which its own plan doesn't show; inputs\n"
          "that an earlier query has stored (contests, features) are read again.\n")
    print("| query | " + " | ".join(n for n, _ in NODES) + " | jobs | sec |")
    print("|---|" + "---|" * (len(NODES) + 2))
    for name, fn in QUERIES.items():
        t0 = time.time()
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        df = fn(spark, sf)
        jobs = len(tracker.getJobIdsForGroup(f"build-{name}"))
        spark.sparkContext.setJobGroup(f"run-{name}", name)
        df.collect()  # runs the query execution whose plan is read next
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        counts = [len(re.findall(rx, plan)) for _, rx in NODES]
        print(f"| {name} | " + " | ".join(str(c) for c in counts) + f" | {jobs} | {time.time() - t0:.1f} |", flush=True)
    st = order_stats(spark, sf)
    text = st._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    print("\n## Contest-table build: scans\n\n```")
    for line in text.splitlines():
        if line.startswith(("ReadSchema", "PushedFilters")) or re.match(r"^\(\d+\) Scan parquet", line):
            print(line)
    print("```")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
