"""Sinks (K1-K6). All writes are distributed Spark writes; a report table's
files are joined after the write so a reader gets one CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import join_parts, remove, replace_folder


def write_records(records: DataFrame, out_dir: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """K1: ShareGPT records, one folder per ``dataset_key`` (JSON lines by
    default, or Parquet). Each line is ``{system, conversations}``. Overwriting
    replaces the folders of the keys written and leaves other datasets alone."""
    w = (records.select("dataset_key", "system", "conversations").write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy("dataset_key"))
    (w.json if fmt == "json" else w.parquet)(out_dir)


def _as_array():
    """Lines of JSON -> the lines of one array a task; workers import nothing of this package."""
    def run(batches):
        import pyarrow as pa

        lead = "["
        for batch in batches:
            lines = [("[" if lead and not i else ",") + v for i, v in enumerate(batch.column(0).to_pylist())]
            if lines:
                lead = ""
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([lead + "]"])], ["value"])
    return run


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1, the array form: every file of the folder is one JSON array of its rows' objects (NULL fields are left out). Each task
    writes a file of its own; ``sources.json_arrays.read_json_arrays`` reads a large one by many tasks again."""
    lines = df.select(F.to_json(F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])).alias("value"))
    arrays = lines.mapInArrow(_as_array(), "value string")
    arrays.write.mode(mode).format("text").save(path)


def write_csv_table(df: DataFrame, path: str, columns: list[str] | None = None,
                    sort_by: list | None = None) -> None:
    """K3 / K6: a report table as one CSV with a header in the folder ``path``; NULL -> empty field.

    Every task writes its own range of the order beside the folder; the files are then joined by the file system and
    the whole table replaces the old one at once. A failed write leaves the old table as it was."""
    spark = df.sparkSession
    out = df.select(*["`" + c.replace("`", "``") + "`" for c in columns]) if columns else df
    if sort_by:
        out = out.orderBy(*sort_by)
    names = [F.lit(c).alias(f"c{i}") for i, c in enumerate(out.columns)]
    header = spark.range(1).select(F.to_csv(F.struct(*names))).first()[0]
    parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    try:
        out.write.csv(parts)
        replace_folder(spark, join_parts(spark, parts, header + "\n"), path, "part-00000.csv")
    finally:
        remove(spark, parts)


def write_traces(traces: DataFrame, path: str, partition_cols=("benchmark",)) -> None:
    """K4: trace rows (one per repeat and question), appended, partitioned
    so later reads prune by benchmark."""
    traces.write.mode("append").partitionBy(*partition_cols).json(path)


def write_run_summaries(summaries: DataFrame, path: str) -> None:
    """K5: run summaries keyed by run name with dynamic partition overwrite:
    rewriting one run leaves every other run's summary in place."""
    s = summaries.withColumn("run_name", F.concat_ws("_", "dataset_name", "mode", "benchmark", "run_id"))
    (s.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_name").json(path))
