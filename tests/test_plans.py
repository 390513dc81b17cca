"""Plan shape of every registered query: no cartesian products or nested-loop
joins, no Python evaluation on the default path, map-side partial
aggregation before each aggregate shuffle, and pruned Parquet reads."""

import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

BATCH_QUERIES = sorted(n for n in E.QUERIES if not n.startswith("stream_"))


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_plan_shape(spark, name):
    p = _plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "EvalPython" not in p and "PythonUDF" not in p
    # every final hash aggregate over a shuffle has a partial aggregate below it
    assert p.count("HashAggregate") % 2 == 0 or "ObjectHashAggregate" in p
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", p):
        assert schema.count(":") <= 6


def test_documents_scans_are_pruned(spark):
    p = _plan(spark, "repeat_stats")
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in p


def test_fixture_filters_pushed(spark):
    p = _plan(spark, "fold_rounds")
    assert "EqualTo(role,assistant)" in p


def test_graded_texts_move_once(spark):
    """Questions too many to broadcast: rounds are laid out by question once, for the fold and for the join."""
    from pyspark.sql import functions as F
    from thinkframe.operators import evaluate

    rounds = spark.range(500).select((F.col("id") % 50).alias("question_id"), (F.floor(F.col("id") / 50) % 5).cast("int").alias("repeat"), F.floor(F.col("id") / 250).cast("int").alias("round"),
                                     F.repeat(F.lit("some text "), 30).alias("text"), F.lit(5).cast("long").alias("prompt_tokens"), F.lit(7).cast("long").alias("output_tokens"),
                                     F.when(F.col("id") < 250, "length").otherwise("stop").alias("finish_reason"))
    questions = spark.range(50).select(F.col("id").alias("question_id"), F.lit("1").alias("reference"))

    def moves(laid_by):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            t = evaluate.grade_traces(evaluate.fold_rounds(rounds, 2, laid_by=laid_by), questions, "math500", "qwen3")
            return t._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), sorted(map(str, t.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (once, a), (twice, b) = moves("question_id"), moves(None)
    assert (once, twice) == (2, 3) and a == b  # one of them moves the questions
