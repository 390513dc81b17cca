"""Write PLANS.md: for each registered query, the shape of its physical plan
(exchanges, join strategies, aggregates, windows, Python evaluation) and
the Parquet scans' pushed filters and read schemas.
Usage: python scripts/plan_summary.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thinkframe.plans.queries import QUERIES  # noqa: E402
from thinkframe.session import get_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    print("# Physical plan summary\n")
    print(f"Generated by `scripts/plan_summary.py` at `{sf}` (plans before AQE re-optimisation; AQE may turn "
          "sort-merge joins into broadcast joins at runtime from measured sizes). Streaming queries are "
          "summarised by their batch equivalents.\n")
    print("| query | exchanges | broadcast joins | sort-merge joins | hash/object aggregates | windows | python "
          "| after AQE: broadcast / sort-merge joins |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    scans = {}
    for n, fn in QUERIES.items():
        if n.startswith("stream_"):
            continue
        df = fn(spark, sf)
        p = df._jdf.queryExecution().executedPlan().toString()
        df.collect()                                       # runs the plan; AQE finalises it
        node = df._jdf.queryExecution().executedPlan()
        try:
            fp = node.executedPlan().toString()            # the adaptive plan's final physical plan
        except Exception:  # noqa: BLE001 - not an adaptive plan
            fp = node.toString()
        ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p))
        aggs = p.count("HashAggregate") + p.count("ObjectHashAggregate") + p.count("SortAggregate")
        py = p.count("EvalPython")
        print(f"| {n} | {ex} | {p.count('BroadcastHashJoin')} | {p.count('SortMergeJoin')} | {aggs} | "
              f"{p.count('Window [')} | {py} | {fp.count('BroadcastHashJoin')} / {fp.count('SortMergeJoin')} |")
        scans[n] = sorted(set(re.findall(r"Location: InMemoryFileIndex\(1 paths\)\[[^\]]*/([a-z_]+)\.parquet\], "
                                         r"PartitionFilters: \[[^\]]*\], PushedFilters: (\[[^\]]*\]), "
                                         r"ReadSchema: (struct<[^>]*>)", p)))
    print("\n## Parquet scans (table, pushed filters, read schema)\n")
    for n, ss in scans.items():
        print(f"- **{n}**: " + "; ".join(f"`{t}` {f} `{r}`" for t, f, r in ss))


if __name__ == "__main__":
    main()
