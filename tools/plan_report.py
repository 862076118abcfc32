"""Summarise the physical plan of every registered query (after execution, so AQE decisions are final).

Usage: python tools/plan_report.py [sf_dir] [name ...]  -> markdown table on stdout.
Counts shuffles, broadcasts, join strategies, aggregate kinds, windows and
scans with pushed filters; flags cartesian / nested-loop joins.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mercato.plans.queries import QUERIES  # noqa: E402
from mercato.session import local_session  # noqa: E402

KEYS = [
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition"),
    ("broadcasts", r"BroadcastExchange"),
    ("smj", r"SortMergeJoin"),
    ("bhj", r"BroadcastHashJoin"),
    ("shj", r"ShuffledHashJoin"),
    ("nlj", r"BroadcastNestedLoopJoin|CartesianProduct"),
    ("hash_agg", r"HashAggregate(?!Exec)"),
    ("obj_agg", r"ObjectHashAggregate"),
    ("sort_agg", r"SortAggregate"),
    ("window", r"\bWindow\b"),
    ("group_limit", r"WindowGroupLimit"),
    ("python", r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython"),
    ("scans", r"FileScan parquet"),
    ("pushed", r"PushedFilters: \[[^\]]+\]"),
]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(shuffle_partitions=16)
    print("| query | " + " | ".join(k for k, _ in KEYS) + " |")
    print("|---|" + "---|" * len(KEYS))
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(rx, plan))) for _, rx in KEYS]
        print(f"| {name} | " + " | ".join(counts) + " |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
