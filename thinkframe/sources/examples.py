"""Raw example scan (S1) and the required-field check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import REQUIRED_FIELDS
from .json_arrays import read_json_arrays

RAW_EXAMPLE_SCHEMA = T.StructType([
    T.StructField("ex_id", T.StringType(), True),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("thinking", T.StringType(), True),
    T.StructField("answer", T.StringType(), True),
])


def load_examples(spark: SparkSession, path: str, id_field: str = "ex_id", fmt: str | None = None) -> DataFrame:
    """Read raw ``{prompt, thinking, answer}`` examples.

    ``fmt``: ``"jsonl"`` (JSON lines; blank lines are skipped and the input
    is splittable across tasks), ``"json"`` (one JSON array per file, also
    read by many tasks, see ``json_arrays``) or ``"parquet"``. By
    default it follows the suffix (``.jsonl``, ``.parquet``, else JSON
    array). The schema is explicit, so a missing key and an explicit null
    both read as NULL. Examples without an id get ``md5`` of their three
    fields as ``ex_id`` (exact copies then share an id).
    """
    if fmt is None:
        fmt = "jsonl" if path.endswith(".jsonl") else "parquet" if path.endswith(".parquet") else "json"
    schema = RAW_EXAMPLE_SCHEMA
    if id_field != "ex_id":
        schema = T.StructType([T.StructField(id_field, T.StringType(), True)] + RAW_EXAMPLE_SCHEMA.fields[1:])
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        df = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in schema.fields])
    elif fmt == "jsonl":
        df = spark.read.schema(schema).json(path)
    elif fmt == "json":
        df = read_json_arrays(spark, path, schema)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if id_field != "ex_id":
        df = df.withColumnRenamed(id_field, "ex_id")
    content_id = F.md5(F.concat_ws("\u0000", *[F.coalesce(F.col(c), F.lit("\u0001")) for c in REQUIRED_FIELDS]))
    return df.withColumn("ex_id", F.coalesce(F.col("ex_id"), content_id))


def missing_fields(df: DataFrame) -> DataFrame:
    """Add ``missing_fields`` (array of required fields that are NULL, in
    field order); ``""`` is a legal value."""
    arr = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_FIELDS])
    return df.withColumn("missing_fields", F.filter(arr, lambda x: x.isNotNull()))


def check_required(df: DataFrame, mode: str = "strict"):
    """P1. ``strict``: the query fails on the first bad example, naming its id
    and fields. ``quarantine``: returns ``(good, bad)`` DataFrames, where
    ``bad`` keeps ``missing_fields``."""
    tagged = missing_fields(df)
    bad_cond = F.size("missing_fields") > 0
    if mode == "strict":
        msg = F.concat(F.lit("Example "), F.col("ex_id").cast("string"),
                       F.lit(" is missing required field(s) "), F.array_join("missing_fields", ", "),
                       F.lit(". Every example needs: " + ", ".join(REQUIRED_FIELDS)))
        # A filter predicate is evaluated for every row, so the check cannot be
        # pruned away the way an unused column would be.
        return tagged.where(F.when(bad_cond, F.raise_error(msg)).otherwise(F.lit(True))).drop("missing_fields")
    if mode == "quarantine":
        return tagged.where(~bad_cond).drop("missing_fields"), tagged.where(bad_cond)
    raise ValueError(f"unknown mode {mode!r}; use 'strict' or 'quarantine'")
