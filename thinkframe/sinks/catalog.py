"""K2: a dataset catalog that several writers may update at once.

A catalog is a folder. Each version is a dataset of entries below ``entries/`` and
one small file ``versions/N.json`` that names it. A writer merges its entries into the latest version,
writes the result under a new name, and publishes it as the next version, which only one
writer can. Whoever finds the number taken merges again into the version that took it.
Versions never change, so readers always see a whole one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prepare import CATALOG_SCHEMA, upsert_catalog
from .files import exists, names_in, publish_once, read_text

ENTRY_SCHEMA = T.StructType(CATALOG_SCHEMA.fields + [T.StructField("num_rows", T.LongType(), True)])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, ascending."""
    found = (n[:-len(".json")] for n in names_in(spark, f"{path.rstrip('/')}/versions") if n.endswith(".json"))
    return sorted(int(n) for n in found if n.isdigit())


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Entries of the latest version, or of ``version``. A path without versions is a plain dataset of entries (JSON lines); an absent one is empty."""
    root = path.rstrip("/")
    known = versions(spark, root)
    if version is None and not known:
        if exists(spark, root) and (not exists(spark, f"{root}/entries")):
            return spark.read.schema(ENTRY_SCHEMA).json(root)
        return spark.createDataFrame([], ENTRY_SCHEMA)
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"catalog {path} has no version {version}")
    place = json.loads(read_text(spark, f"{root}/versions/{version:020d}.json"))["entries"]
    return spark.read.schema(ENTRY_SCHEMA).json(f"{root}/{place}")


def commit_catalog(spark: SparkSession, path: str, new: DataFrame, attempts: int = 100) -> int:
    """Merge ``new`` entries into the catalog and publish the result; returns its version.

    Entries of ``new`` replace entries of the same key, all others stay. When another writer publishes first, the merge is
    done again on top of its version, so no writer's entries are lost.
    """
    root = path.rstrip("/")
    rows = new.select(*[F.col(f.name).cast(f.dataType) for f in ENTRY_SCHEMA.fields]).collect()  # a few entries a dataset
    new = spark.createDataFrame(rows, ENTRY_SCHEMA)
    for _ in range(attempts):
        known = versions(spark, root)
        base = known[-1] if known else 0
        merged = upsert_catalog(read_catalog(spark, root, base or None), new)
        place = f"entries/{uuid.uuid4().hex}"
        merged.write.json(f"{root}/{place}")
        if publish_once(spark, f"{root}/versions/{base + 1:020d}.json", json.dumps({"version": base + 1, "base": base, "entries": place})):
            return base + 1
    raise RuntimeError(f"catalog {path}: {attempts} attempts met other writers")


def catalog_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every version, with ``version``."""
    out = spark.createDataFrame([], T.StructType([T.StructField("version", T.LongType()), *ENTRY_SCHEMA.fields]))
    for v in versions(spark, path):
        out = out.unionByName(read_catalog(spark, path, v).withColumn("version", F.lit(v).cast("long")))
    return out
