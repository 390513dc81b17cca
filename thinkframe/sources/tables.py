"""Access to the driver's parquet tables."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession

from ..streaming import stream_files

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# One resolved DataFrame (plan + file index, not data) per session and path:
# resolving a Parquet source lists its files and reads a footer, which costs
# more than building most query plans on small inputs. The driver tables are
# read-only, so reusing the resolved relation is safe.
_RESOLVED: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 8) -> DataFrame:
    """A driver table read as a stream of its files. The path is a pattern that only this name fits,
    since a plain path has to be a folder and a table may be one file."""
    path = f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet"
    return stream_files(spark, path, read_table(spark, sf_dir, name).schema, files_per_batch)


def read_table(spark: SparkSession, sf_dir: str, name: str, reuse: bool = True) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if not reuse:
        return spark.read.parquet(path)
    per = _RESOLVED.setdefault(spark, {})
    if path not in per:
        per[path] = spark.read.parquet(path)
    return per[path]
