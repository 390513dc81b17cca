"""Intermediate tables in the folder the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import zipfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: Spark hands a zip of its sources to every executor, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "thinkframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid4().hex}"


def staged(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and lost executors cost nothing.

    With ``free`` the driver's garbage is collected, which lets Spark drop the shuffle files of what was written.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if free:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 32_000_000) -> int:
    """Partitions of about ``each`` bytes, at least as many as the session shuffles into."""
    return max(shuffle_width(spark), math.ceil(n_bytes / each))


def nfc(name: str):
    """A column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")
