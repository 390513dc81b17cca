"""Model-family dimensions (S10 training side, S11 evaluation side).

Both are fixed, tiny tables (2 and 5 rows), so joining them with
``broadcast`` is size-safe by construction. Single-family lookups resolve on
the driver and become literals that Catalyst folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EVAL_FAMILIES, EVAL_MODEL_FAMILIES, TRAIN_FAMILIES, PROMPT_HEADROOM

TRAIN_FAMILY_SCHEMA = T.StructType([
    T.StructField("model_family", T.StringType(), False),
    T.StructField("template", T.StringType(), False),
    T.StructField("think_open", T.StringType(), False),
    T.StructField("think_close", T.StringType(), False),
])

EVAL_FAMILY_SCHEMA = T.StructType([
    T.StructField("model_family", T.StringType(), False),
    T.StructField("template", T.StringType(), False),
    T.StructField("base_model", T.StringType(), False),
    T.StructField("forced_prefix", T.StringType(), False),
    T.StructField("enable_thinking", T.BooleanType(), False),
    T.StructField("sampling_params", T.MapType(T.StringType(), T.DoubleType()), False),
    T.StructField("recommended_max_new_tokens", T.IntegerType(), False),
    T.StructField("native_max_context", T.IntegerType(), False),
    T.StructField("max_continuation_rounds", T.IntegerType(), False),
    T.StructField("continuation_max_new_tokens_override", T.IntegerType(), True),
])


def _unsupported(kind: str, name: str, known) -> ValueError:
    return ValueError(f"Unsupported {kind} model_family {name!r}; supported: {tuple(known)}")


def train_family(name: str) -> tuple:
    try:
        return TRAIN_FAMILIES[name]
    except KeyError:
        raise _unsupported("training", name, TRAIN_FAMILIES) from None


def think_tags(name: str) -> tuple[str, str]:
    f = train_family(name)
    return f[1], f[2]


def template(name: str) -> str:
    return train_family(name)[0]


def eval_family(name: str) -> tuple:
    try:
        return EVAL_FAMILIES[name]
    except KeyError:
        raise _unsupported("eval", name, EVAL_FAMILIES) from None


def base_model_path(name: str) -> str:
    return eval_family(name)[1]


def forced_assistant_prefix(name: str) -> str:
    return eval_family(name)[2]


def needs_enable_thinking(name: str) -> bool:
    return eval_family(name)[3]


def sampling_params_for(name: str) -> dict:
    return dict(eval_family(name)[4])


def max_continuation_rounds_for(name: str) -> int:
    return eval_family(name)[7]


def continuation_max_new_tokens_for(name: str, max_new_tokens: int) -> int:
    override = eval_family(name)[8]
    return max_new_tokens if override is None else override


def required_max_model_len(name: str, max_new_tokens: int, max_continuation_rounds: int | None = None,
                           continuation_max_new_tokens: int | None = None,
                           prompt_headroom: int = PROMPT_HEADROOM) -> int:
    """Worst-case context over all rounds, clamped to the native context (P10)."""
    rounds = max_continuation_rounds_for(name) if max_continuation_rounds is None else max_continuation_rounds
    cont = (continuation_max_new_tokens_for(name, max_new_tokens)
            if continuation_max_new_tokens is None else continuation_max_new_tokens)
    return min(prompt_headroom + max_new_tokens + rounds * cont, eval_family(name)[6])


def train_family_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in TRAIN_FAMILIES.items()]
    return F.broadcast(spark.createDataFrame(rows, TRAIN_FAMILY_SCHEMA))


def eval_family_dim(spark: SparkSession) -> DataFrame:
    rows = []
    for k in EVAL_MODEL_FAMILIES:
        f = list(EVAL_FAMILIES[k])
        f[4] = {p: float(v) for p, v in f[4].items()}
        rows.append((k, *f))
    return F.broadcast(spark.createDataFrame(rows, EVAL_FAMILY_SCHEMA))


def with_eval_family(df: DataFrame, family_col: str = "model_family", max_new_tokens=None,
                     prompt_headroom: int = PROMPT_HEADROOM, strict: bool = True) -> DataFrame:
    """Attach S11 settings per row (broadcast join against the 5-row dimension).

    Adds ``continuation_max_new_tokens`` (override, else ``max_new_tokens``)
    and ``max_model_len`` (P10). Unknown families fail the query when
    ``strict``; otherwise their settings are NULL.
    """
    spark = df.sparkSession
    dim = eval_family_dim(spark)
    mnt = F.col("max_new_tokens") if max_new_tokens is None else F.lit(max_new_tokens)
    out = df.join(dim, on=family_col, how="left")
    if strict:
        out = out.where(F.when(F.col("template").isNull(), F.raise_error(
            F.concat(F.lit("Unsupported eval model_family "), F.col(family_col)))).otherwise(F.lit(True)))
    cont = F.coalesce(F.col("continuation_max_new_tokens_override"), mnt)
    return (out.withColumn("continuation_max_new_tokens", cont)
            .withColumn("max_model_len", F.least(
                F.lit(prompt_headroom) + mnt + F.col("max_continuation_rounds") * cont,
                F.col("native_max_context"))))


def with_train_family(df: DataFrame, family_col: str = "model_family", strict: bool = True) -> DataFrame:
    """S10 per row: attach the training family's template and tags (broadcast
    join against the 2-row dimension). Unknown families fail the query when
    ``strict``; otherwise their settings are NULL."""
    out = df.join(train_family_dim(df.sparkSession), on=family_col, how="left")
    if strict:
        out = out.where(F.when(F.col("template").isNull(), F.raise_error(
            F.concat(F.lit("Unsupported training model_family "), F.col(family_col)))).otherwise(F.lit(True)))
    return out
