"""Benchmark sources (S2-S6) and the deterministic choice permutation.

Every reader returns the uniform shape ``(benchmark, pos, id, question,
reference, choices)``; ``pos`` is the question's position in its source
(used for first-N cuts and the permutation seed), ``choices`` is a
``map<string,string>`` for multiple choice and NULL otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BENCHMARKS, CHOICE_LETTERS, CHOICE_SEED_PREFIX
from ..functions._util import col

CHOICES_TYPE = T.MapType(T.StringType(), T.StringType())


def _uniform(df: DataFrame, benchmark: str, pos, id_c, question, reference) -> DataFrame:
    return df.select(F.lit(benchmark).alias("benchmark"), col(pos).cast("long").alias("pos"),
                     id_c.alias("id"), col(question).alias("question"), reference.alias("reference"),
                     F.lit(None).cast(CHOICES_TYPE).alias("choices"))


def aime24(df: DataFrame, pos="pos") -> DataFrame:
    """Columns ``ID, Problem, Answer``; answer cast to string, id kept as is."""
    return _uniform(df, "aime24", pos, F.col("ID"), "Problem", F.col("Answer").cast("string"))


def aime25(df: DataFrame, pos="pos") -> DataFrame:
    """S3: columns ``id, problem, answer``; id and answer cast to string."""
    return _uniform(df, "aime25", pos, F.col("id").cast("string"), "problem", F.col("answer").cast("string"))


def math500(df: DataFrame, pos="pos") -> DataFrame:
    """Columns ``unique_id, problem, answer``; answer left as is."""
    return _uniform(df, "math500", pos, F.col("unique_id"), "problem", F.col("answer"))


def _md5_order(pos: Column, seed_prefix: str) -> Column:
    """Permutation of 0..3 ordered by md5('{prefix}-{pos}-{j}')."""
    keyed = F.array(*[F.struct(F.md5(F.concat(F.lit(seed_prefix + "-"), pos.cast("string"), F.lit(f"-{j}"))).alias("k"),
                               F.lit(j).alias("j")) for j in range(4)])
    return F.transform(F.array_sort(keyed), lambda s: s["j"])


def permute_choices(df: DataFrame, pos="pos", options=("o0", "o1", "o2", "o3"),
                    seed_prefix: str = CHOICE_SEED_PREFIX) -> DataFrame:
    """Shuffle four options (the first is correct) with a per-question seed.

    Adds ``choices`` (letter -> option text) and ``reference`` (letter of the
    correct option). Options are ordered by
    ``md5('{seed_prefix}-{pos}-{j}')``: deterministic and decorrelated from
    position.
    """
    p = col(pos)
    opts = F.array(*[col(o) for o in options])
    tmp = df.withColumn("_order", _md5_order(p, seed_prefix))
    shuffled = F.transform(F.col("_order"), lambda j: F.element_at(opts, j + 1))
    letter = F.element_at(F.array(*[F.lit(L) for L in CHOICE_LETTERS]),
                          F.array_position(F.col("_order"), 0).cast("int"))
    return (tmp.withColumn("choices", F.map_from_arrays(F.array(*[F.lit(L) for L in CHOICE_LETTERS]), shuffled))
            .withColumn("reference", letter).drop("_order"))


def gpqa_diamond(df: DataFrame, pos="pos") -> DataFrame:
    """Columns ``Record ID, Question, Correct Answer, Incorrect Answer 1-3``."""
    opts = ("Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3")
    p = permute_choices(df, pos, opts)
    return p.select(F.lit("gpqa_diamond").alias("benchmark"), col(pos).cast("long").alias("pos"),
                    F.col("Record ID").alias("id"), F.col("Question").alias("question"), "reference", "choices")


READERS = {"aime24": aime24, "aime25": aime25, "math500": math500, "gpqa_diamond": gpqa_diamond}


def load_benchmark(name: str, df: DataFrame, pos="pos") -> DataFrame:
    """Dispatch by name; unknown names raise."""
    if name not in READERS:
        raise ValueError(f"unknown benchmark: {name}")
    return READERS[name](df, pos)


def load_benchmarks(sources: dict) -> DataFrame:
    """S6 over several benchmarks: ``{name: raw DataFrame}`` -> one union."""
    out = None
    for name in BENCHMARKS:
        if name in sources:
            d = load_benchmark(name, sources[name])
            out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no benchmark sources given")
    return out
