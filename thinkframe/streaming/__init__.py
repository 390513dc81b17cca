"""Structured Streaming jobs (file source, ``trigger(availableNow=True)``).

Each micro-batch lands its rows under its batch id, so a batch that is retried
after a failure replaces its own rows. Every ``COMPACT_EVERY`` batches all that has
landed is folded into a snapshot, and what older snapshots cover is removed; a reader folds the newest
snapshot with the few batches after it, so its cost follows the keys, not the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.files import exists, names_in, remove

COMPACT_EVERY = 16


def stream_files(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of ``path`` (a folder or one file) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(keys) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps the row of each key from the highest batch."""
    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
        g = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
        return g.select(*keys, *[F.col("s")[c].alias(c) for c in rest], "batch_id")
    return fold


def _done(spark: SparkSession, folder: str) -> list[int]:
    """Numbered folders whose write has finished, ascending."""
    return sorted(int(n) for n in names_in(spark, folder) if n.lstrip("-").isdigit() and exists(spark, f"{folder}/{n}/_SUCCESS"))


def _covered(spark: SparkSession, out_dir: str, upto: int | None, before: int | None = None) -> tuple[int, list[str]]:
    """(the snapshot to start from, its folder and those of the batches after it)."""
    start = max(n for n in _done(spark, f"{out_dir}/snapshots") if (upto is None or n <= upto) and (before is None or n < before))
    later = [n for n in _done(spark, f"{out_dir}/batches") if n > start and (upto is None or n <= upto)]
    return start, [f"{out_dir}/snapshots/{start}", *[f"{out_dir}/batches/{n}" for n in later]]


def landed(spark: SparkSession, out_dir: str, fold, upto: int | None = None) -> DataFrame:
    """All that batches up to ``upto`` have landed (by default all batches), folded."""
    return fold(spark.read.parquet(*_covered(spark, out_dir, upto)[1])).drop("batch_id")


def compact(spark: SparkSession, out_dir: str, fold, batch_id: int) -> None:
    """A snapshot of everything up to ``batch_id``. It starts from an older one also when it is made again, so it is the same each time.

    The older one and the batches after it stay for readers that have begun; what that one covers goes.
    """
    start, folders = _covered(spark, out_dir, batch_id, before=batch_id)
    fold(spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{out_dir}/snapshots/{batch_id}")
    for kind, keep in (("snapshots", start), ("batches", start + 1)):
        for name in names_in(spark, f"{out_dir}/{kind}"):
            if name.lstrip("-").isdigit() and int(name) < keep:
                remove(spark, f"{out_dir}/{kind}/{name}")


def write_changes(changes: DataFrame, out_dir: str, checkpoint: str, fold, mode: str = "update", shape=None, after=None,
                  compact_every: int = COMPACT_EVERY):
    """Start a query that lands the rows each batch emits (``shape``d first, if given) and compacts them by ``fold``.

    ``fold`` maps landed rows, with their ``batch_id``, to fewer of the same columns; folding folded rows with later ones must
    equal folding all. ``after(batch_id)`` runs once a batch has landed, again if the batch is retried. The folder holds an
    empty snapshot from the start, so it can be read before the first batch.
    """
    spark = changes.sparkSession
    empty = spark.createDataFrame([], changes.schema)
    (shape(empty) if shape else empty).withColumn("batch_id", F.lit(-1).cast("long")).write.mode("ignore").parquet(f"{out_dir}/snapshots/-1")

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = (shape(batch) if shape else batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(f"{out_dir}/batches/{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, out_dir, fold, batch_id)
        if after:
            after(batch_id)

    return (changes.writeStream.outputMode(mode).foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def batch_rows(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame:
    """What one batch has landed."""
    return spark.read.parquet(f"{out_dir}/batches/{batch_id}").drop("batch_id")


def last_commit(spark: SparkSession, checkpoint: str) -> int:
    """The last batch a query has finished (-1: none)."""
    return max((int(n) for n in names_in(spark, f"{checkpoint}/commits") if n.isdigit()), default=-1)


def rows_too_late(query) -> int:
    """Rows that the recent batches of a query left out because they came behind its watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
