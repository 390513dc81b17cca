"""Flagship: model responses -> reasoning/answer split (A1) -> boxed-answer
grading (A2-A5) -> accuracy per language (G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import staged
from ..sources import fixtures


def accuracy_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.model_responses(spark, sf_dir)
    g = staged.with_grade_math(staged.with_split_think_answer(r, "", "response"), "answer", "reference")
    return (g.groupBy("lang").agg(
        F.count(F.lit(1)).alias("num_questions"),
        F.count_if(F.col("is_correct")).alias("num_correct"),
        F.count_if(F.col("extracted").isNull()).alias("num_unanswered"))
        .withColumn("accuracy", F.round(F.col("num_correct") / F.col("num_questions"), 9)))
