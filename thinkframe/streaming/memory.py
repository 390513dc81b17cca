"""ST2: running GPU-memory peak over samples.

A stateful streaming aggregation sums the GPUs of each exact sample time of a
run. A failed (NULL) reading voids its sample, as in the batch operator (G11). There are two forms:

* ``start_memory_stream`` takes readings in any order, however late. It keeps every sample's total and lands those that a batch changed.
* ``start_bounded_memory_stream`` is for a sampler that runs for weeks: a sample is closed once the newest reading is ``delay`` past
  it, folded into its run's peak, and forgotten. State and landed rows follow the open samples and the runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import COMPACT_EVERY, landed, last_commit, latest, write_changes


def _totals(samples: DataFrame, watermark: str | None) -> DataFrame:
    src = samples.withColumn("sample_ts", F.col("sample_ts").cast("timestamp"))
    if watermark:
        src = src.withWatermark("sample_ts", watermark)
    return src.groupBy("run_id", "sample_ts").agg(
        F.sum("mem").alias("total"), F.count_if(F.col("mem").isNull()).cast("long").alias("n_fail"))


def _peaks(totals: DataFrame) -> DataFrame:
    valid = F.col("n_fail") == 0
    return totals.groupBy("run_id").agg(F.max(F.when(valid, F.col("total"))).alias("peak"), F.count_if(valid).cast("long").alias("num_samples"))


def _merged(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("run_id").agg(F.max("peak").alias("peak"), F.sum("num_samples").alias("num_samples"), F.max("batch_id").alias("batch_id"))


def _shown(peaks: DataFrame) -> DataFrame:
    return peaks.select("run_id", F.when(F.col("peak") > 0, F.col("peak")).alias("peak_gpu_memory_mib_total"), "num_samples")


_BY_TIME = latest(("run_id", "sample_ts"))


def start_memory_stream(samples: DataFrame, out_dir: str, checkpoint: str, watermark: str | None = None, compact_every: int = COMPACT_EVERY):
    """Start the stream over ``samples`` (run_id, gpu, sample_ts, mem).

    The state is one row per run and sample time. With a ``watermark`` Spark
    drops the state of old times and ignores rows later than that;
    without one, rows may come in any order, as from the files of a stored table.
    """
    return write_changes(_totals(samples, watermark), out_dir, checkpoint, _BY_TIME, compact_every=compact_every)


def read_current_peaks(spark: SparkSession, out_dir: str) -> DataFrame:
    """Peak and number of valid samples per run over all that has landed."""
    return _shown(_peaks(landed(spark, out_dir, _BY_TIME)))


def start_bounded_memory_stream(samples: DataFrame, out_dir: str, checkpoint: str, delay: str, compact_every: int = COMPACT_EVERY):
    """Start the stream over ``samples`` (run_id, gpu, sample_ts, mem), keeping only open samples.

    Event time closes a sample: when a batch has seen a reading of any run more than ``delay`` (a duration) later, the
    sample is emitted once, whole, and its state goes. A reading that comes after its sample has closed is left
    out, a failed one too; ``rows_too_late`` counts them. Sample times are exact, no two are put together.
    """
    return write_changes(_totals(samples, delay), out_dir, checkpoint, _merged, "append", _peaks, compact_every=compact_every)


def open_samples(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run_id, sample_ts, total, n_fail): samples still in the state of a bounded stream, read from its checkpoint."""
    commit = last_commit(spark, checkpoint)
    if commit < 0:
        return spark.createDataFrame([], "run_id string, sample_ts timestamp, total double, n_fail long")
    state = spark.read.format("statestore").option("batchId", commit).load(checkpoint)
    return state.select("key.run_id", "key.sample_ts", F.col("value.sum").alias("total"), F.col("value.count").alias("n_fail"))


def read_bounded_peaks(spark: SparkSession, out_dir: str, checkpoint: str | None = None) -> DataFrame:
    """Peak and number of valid samples per run over the closed samples; with the stream's ``checkpoint``, over the open ones too, as of its last finished batch."""
    if checkpoint is None:
        return _shown(landed(spark, out_dir, _merged))
    closed = landed(spark, out_dir, _merged, last_commit(spark, checkpoint))
    still = _peaks(open_samples(spark, checkpoint)).select(*closed.columns)
    return _shown(_merged(closed.unionByName(still).withColumn("batch_id", F.lit(0).cast("long"))))
