"""Skew: aggregations combine map-side before shuffling, and a run holding
almost all rows is summarised correctly."""

import random
import statistics

from pyspark.sql import functions as F

import __spark_entry__ as E
from thinkframe.operators import report, stats
from thinkframe.plans import queries as Q

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partial_aggregation_before_shuffles(spark):
    checks = {"repeat_stats": ["partial_count", "partial_sum", "partial_percentile"],
              "best_run_per_cell": ["partial_min_by"],
              "memory_peak": ["partial_sum", "partial_max"],
              "final_table": ["partial_max_by"]}
    for name, needles in checks.items():
        p = _plan(E.queries()[name](spark, SF_SMALL))
        for n in needles:
            assert n in p, (name, n)


def test_hot_run_statistics(spark):
    t = Q._traces_f4(spark, SF_SMALL)
    hot = t.withColumn("dataset_name", F.when(F.col("question_id") % 50 != 0, F.lit("s1k11_all_qwen3"))
                       .otherwise(F.col("dataset_name"))) \
           .withColumn("run_id", F.when(F.col("question_id") % 50 != 0, F.lit("run1")).otherwise(F.col("run_id"))) \
           .withColumn("mode", F.when(F.col("question_id") % 50 != 0, F.lit("cotgen")).otherwise(F.col("mode"))) \
           .withColumn("benchmark", F.when(F.col("question_id") % 50 != 0, F.lit("aime24")).otherwise(F.col("benchmark")))
    pr = stats.repeat_stats(hot)
    rows = {(r.dataset_name, r.run_id, r.repeat): r for r in pr.collect()}
    hot_rows = hot.where("dataset_name = 's1k11_all_qwen3' AND run_id = 'run1' AND mode = 'cotgen' "
                         "AND benchmark = 'aime24' AND repeat = 0").collect()
    r = rows[("s1k11_all_qwen3", "run1", 0)]
    assert r.num_questions == len(hot_rows)
    assert r.num_correct == sum(1 for x in hot_rows if x.is_correct)
    assert r.total_output_tokens == sum(x.output_tokens for x in hot_rows)
    vals = sorted(x.reasoning_tokens for x in hot_rows)
    mid = len(vals) // 2
    median = vals[mid] if len(vals) % 2 else (vals[mid - 1] + vals[mid]) / 2
    assert r.median_reasoning_tokens == median
    s = stats.run_summary(pr).where("run_id = 'run1' AND dataset_name = 's1k11_all_qwen3' AND mode = 'cotgen' "
                                    "AND benchmark = 'aime24'").first()
    assert s.num_repeats_completed == 3
    assert report.best_run_per_cell(report.eval_rows(Q.eval_summaries(spark, SF_SMALL))).count() > 0


def test_spread_median_equals_the_sorted_middle(spark):
    """Groups of every size, ties, negative and wide values, nulls in values and keys; one group holds almost all rows."""
    rng = random.Random(6)
    rows = [("hot", rng.choice((0, 7, 7, -3, 2**40, rng.randint(0, 10**6)))) for _ in range(4000)]
    rows += [(f"g{n}", rng.randint(-5, 5)) for n in range(1, 9) for _ in range(n)]
    rows += [(None, 4), (None, 9), ("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    got = {r.k: r.m for r in stats.spread_median(df, ["k"], F.col("v"), "m").collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in groups.items()} and "empty" not in got


def test_hot_run_is_counted_by_all_tasks(spark):
    """One run holds every row: its values are dealt by (run, value), and no window sees more than a share of them."""
    df = spark.range(20000).select(F.lit("run").alias("k"), (F.col("id") * 7919 % 20000).alias("v"))
    plan = _plan(stats.spread_median(df, ["k"], F.col("v"), "m"))
    assert "partial_count" in plan and "percentile" not in plan
    assert stats.spread_median(df, ["k"], F.col("v"), "m").first().m == 9999.5
