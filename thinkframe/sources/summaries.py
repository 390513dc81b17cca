"""Run-summary scans (S7-S9): JSON files, one run per file, with the file
path kept as ``source_path``. Missing directories contribute no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import SUMMARY_SUFFIX


def _existing_globs(spark: SparkSession, dirs, pattern: str) -> list[str]:
    """Globs that match a file, on whatever file system each folder is on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for d in dirs:
        glob = d.rstrip("/") + "/" + pattern
        path = jvm.org.apache.hadoop.fs.Path(glob)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found):
            out.append(glob)
    return out


SUMMARY_FILES = "*" + SUMMARY_SUFFIX       # one pretty-printed JSON document per file
SPARK_SUMMARIES = "run_name=*/*.json"      # JSON lines written by sinks.write_run_summaries


def read_summaries(spark: SparkSession, dirs, schema, pattern: str = SUMMARY_FILES) -> DataFrame:
    paths = _existing_globs(spark, [dirs] if isinstance(dirs, str) else list(dirs), pattern)
    if not paths:
        return spark.createDataFrame([], schema).withColumn("source_path", F.lit(None).cast("string"))
    df = spark.read.schema(schema).json(paths, multiLine=(pattern == SUMMARY_FILES), mode="FAILFAST")
    return df.withColumn("source_path", F.col("_metadata.file_path"))


def load_train_summaries(spark: SparkSession, results_dir, pattern: str = SUMMARY_FILES) -> DataFrame:
    """Training summaries."""
    return read_summaries(spark, results_dir, schemas.TRAIN_SUMMARY, pattern)


def load_eval_summaries(spark: SparkSession, eval_dirs, pattern: str = SUMMARY_FILES) -> DataFrame:
    """Evaluation summaries (D11) from several directories (E2). Use
    ``pattern=SPARK_SUMMARIES`` for summaries written by this library's
    ``write_run_summaries``."""
    return read_summaries(spark, eval_dirs, schemas.EVAL_SUMMARY, pattern)
