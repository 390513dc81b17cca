"""Reports over run summaries: training run summaries and their flat CSV
(P14, P21, A18, Q5), the train x eval table (J1, Q2, P13, P17, P20, Q4,
A14), best run per cell (Q1), the mode pivot (J2, J3, J5, E1, G10, P18,
P19) and the memory peak (G11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (FINAL_TABLE_FIELDS, PIVOT_ABLATIONS, PIVOT_BENCHMARKS, PIVOT_MODES,
                         SUMMARY_SUFFIX, TRAIN_RESULT_METRICS, TRAIN_SUMMARY_FIELDS)
from ..functions.formatting import duration_text, iso_seconds, parse_dataset_name


def train_run_summary(run_log: DataFrame) -> DataFrame:
    """P21 + A18: run-log rows -> training summaries.

    status from the exit code; whole elapsed seconds (truncated); UTC ISO
    times; GPU count from the comma list; peak memory 0 -> NULL; train
    results only for successful runs. Expects dataset_name, mode, attempt,
    start_ts, end_ts, exit_code, gpu_ids, peak_mem and the metric columns.
    """
    elapsed = F.floor((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1_000_000).cast("long")
    ok = F.col("exit_code") == 0
    tr = F.struct(F.col("train_runtime").cast("double").alias("train_runtime"),
                  F.lit(None).cast("double").alias("train_samples_per_second"),
                  F.lit(None).cast("double").alias("train_steps_per_second"),
                  F.col("train_loss").cast("double").alias("train_loss"),
                  F.col("total_flos").cast("double").alias("total_flos"),
                  F.lit(None).cast("double").alias("eval_loss"),
                  F.col("num_input_tokens_seen").cast("long").alias("num_input_tokens_seen"))
    key = F.concat_ws("_", "dataset_name", "mode")
    return run_log.select(
        "dataset_name", "mode", "gpu_ids",
        F.size(F.split("gpu_ids", ",")).cast("long").alias("num_gpus"),
        F.concat(F.lit("configs/"), key, F.lit(".yaml")).alias("config"),
        F.concat(F.lit("ckpt/"), key).alias("output_dir"),
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("status"),
        iso_seconds("start_ts").alias("start_time"), iso_seconds("end_ts").alias("end_time"),
        elapsed.alias("wall_clock_seconds"),
        duration_text(elapsed).alias("elapsed_text"),
        F.when(F.col("peak_mem") > 0, F.col("peak_mem")).alias("peak_gpu_memory_mib_total"),
        F.when(ok, tr).alias("train_results"),
        F.concat(F.lit("results/attempt"), F.col("attempt").cast("string"), F.lit("/"), key,
                 F.lit(SUMMARY_SUFFIX)).alias("source_path"))


def flatten_train_summary(summaries: DataFrame) -> DataFrame:
    """The fixed CSV columns; the six metrics come only from the nested
    ``train_results`` (NULL when it is NULL). Sorted by source path (Q5)."""
    cols = []
    for f in TRAIN_SUMMARY_FIELDS:
        if f in TRAIN_RESULT_METRICS:
            cols.append(F.col("train_results").getField(f).alias(f))
        elif f in summaries.columns:
            cols.append(F.col(f))
        else:
            cols.append(F.lit(None).cast("string").alias(f))
    extra = [c for c in ("source_path", "elapsed_text") if c in summaries.columns]
    return summaries.select(*cols, *extra)


def dedup_train_summaries(summaries: DataFrame) -> DataFrame:
    """Q2: last one wins per (dataset_name, mode), by end_time then path.
    A ``max_by`` aggregate (partial aggregation, no window)."""
    cols = [c for c in summaries.columns if c not in ("dataset_name", "mode")]
    best = F.max_by(F.struct(*cols), F.struct("end_time", "source_path"))
    return (summaries.groupBy("dataset_name", "mode").agg(best.alias("_b"))
            .select("dataset_name", "mode", *[F.col("_b")[c].alias(c) for c in cols]))


def final_table(eval_summaries: DataFrame, train_summaries: DataFrame, sort: bool = True) -> DataFrame:
    """J1 + P13 + P17 + A14 + Q4: one row per eval summary with its
    training columns (left join on dataset_name, mode after Q2). The train
    side is one row per training run; AQE broadcasts it from its measured
    size, otherwise it is a shuffle join."""
    t = dedup_train_summaries(train_summaries).select(
        "dataset_name", "mode",
        F.col("train_results.total_flos").alias("train_total_flos"),
        F.col("train_results.train_runtime").alias("train_runtime_seconds"),
        F.col("train_results.num_input_tokens_seen").alias("train_num_input_tokens_seen"))
    e = eval_summaries.withColumn("_p", parse_dataset_name(F.col("dataset_name")))
    j = e.join(t, ["dataset_name", "mode"], "left")
    seen, rt = F.col("train_num_input_tokens_seen"), F.col("train_runtime_seconds")
    out = j.select(
        F.col("_p.model").alias("model"), F.col("_p.ablation").alias("ablation"),
        F.col("mode").alias("training_method"), "benchmark", "run_id",
        F.col("num_repeats").alias("num_eval_repeats"),
        F.coalesce("num_repeats_completed", "num_repeats").alias("num_eval_repeats_completed"),
        F.coalesce("is_complete", F.lit(True)).alias("eval_is_complete"),
        "train_total_flos", "train_runtime_seconds", "train_num_input_tokens_seen",
        F.when((seen != 0) & (rt != 0), seen / rt).alias("train_tokens_per_sec"),
        F.col("accuracy_mean").alias("eval_accuracy_mean"),
        F.col("accuracy_std").alias("eval_accuracy_std"),
        F.col("accuracy_mean_excl_extended").alias("eval_accuracy_mean_excl_extended"),
        F.col("accuracy_std_excl_extended").alias("eval_accuracy_std_excl_extended"),
        F.col("num_extended_total").alias("eval_num_extended_total"),
        F.col("num_extended_correct_total").alias("eval_num_extended_correct_total"),
        F.col("num_extended_incorrect_total").alias("eval_num_extended_incorrect_total"),
        F.col("extended_accuracy_mean").alias("eval_extended_accuracy_mean"),
        F.col("num_still_truncated_total").alias("eval_num_still_truncated_total"),
        F.col("mean_extended_reasoning_tokens_added_mean").alias("eval_mean_extended_reasoning_tokens_added"),
        F.col("output_tokens_per_sec_mean").alias("eval_output_tokens_per_sec_mean"),
        F.col("input_tokens_per_sec_mean").alias("eval_input_tokens_per_sec_mean"),
        F.col("queries_per_sec_mean").alias("eval_queries_per_sec_mean"),
        F.col("mean_reasoning_tokens_mean").alias("eval_mean_reasoning_tokens"),
        F.col("num_questions").alias("eval_num_questions"))
    assert out.columns == FINAL_TABLE_FIELDS
    if sort:
        out = out.orderBy("model", "ablation", "training_method", "benchmark", F.asc_nulls_first("run_id"))
    return out


def missing_train_rows(final: DataFrame) -> DataFrame:
    """P20: non-base rows without training data."""
    return final.where(F.col("train_total_flos").isNull() & (F.col("ablation") != "base"))


def eval_rows(eval_summaries: DataFrame) -> DataFrame:
    """One row per summary file with the pivot's columns (S8 + A14 + P13)."""
    p = parse_dataset_name(F.col("dataset_name"))
    return eval_summaries.select(
        p["model"].alias("model"), p["ablation"].alias("ablation"), "benchmark", "mode", "run_id",
        "accuracy_mean",
        F.coalesce("num_repeats_completed", "num_repeats").alias("num_repeats_completed"),
        F.col("num_repeats").alias("num_repeats_target"),
        F.coalesce("is_complete", F.lit(True)).alias("is_complete"), "source_path")


CELL = ("model", "ablation", "benchmark", "mode")


def best_run_per_cell(rows: DataFrame) -> DataFrame:
    """Q1: per (model, ablation, benchmark, mode) the run with the most
    completed repeats; ties go to the smallest source path. A ``min_by``
    aggregate, so no window and no hot partition."""
    cols = [c for c in rows.columns if c not in CELL]
    key = F.struct((-F.col("num_repeats_completed")).alias("k"), F.col("source_path"))
    return (rows.groupBy(*CELL).agg(F.min_by(F.struct(*cols), key).alias("_b"))
            .select(*CELL, *[F.col("_b")[c].alias(c) for c in cols]))


def _skeleton(spark, models) -> DataFrame:
    """Models x ablations x benchmarks, built with generators."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (spark.range(1)
            .select(F.explode(arr(models)).alias("model"))
            .select("model", F.explode(arr(PIVOT_ABLATIONS)).alias("ablation"))
            .select("model", "ablation", F.explode(arr(PIVOT_BENCHMARKS)).alias("benchmark")))


def mode_pivot(rows: DataFrame, models) -> DataFrame:
    """J2 + J3 + J5 + E1 + G10 + P18 + P19: one row per (model, ablation,
    benchmark) in the full grid, with ``{mode}_acc`` / ``{mode}_progress``
    and ``delta_cotcond_vs_cotgen_pct``. Base runs have no ablation of their
    own and appear in every ablation."""
    # Only cells of the requested grid can appear in the output, so rows are
    # restricted to it first; the pivoted side then has at most
    # len(models) x len(ablations) x len(benchmarks) rows, a proven bound that
    # makes the broadcast below safe.
    rows = rows.where(F.col("model").isin(*models) & F.col("benchmark").isin(*PIVOT_BENCHMARKS)
                      & (F.col("ablation").isin(*PIVOT_ABLATIONS) | (F.col("mode") == "base")))
    # Base runs enter every ablation first, so that Q1's rule also settles two base runs that meet in a cell.
    base = (rows.where(F.col("mode") == "base")
            .withColumn("ablation", F.explode(F.array(*[F.lit(a) for a in PIVOT_ABLATIONS]))))
    cells = best_run_per_cell(rows.where(F.col("mode") != "base").unionByName(base))
    prog = F.concat(F.col("num_repeats_completed").cast("string"), F.lit("/"),
                    F.col("num_repeats_target").cast("string"))
    pv = (cells.withColumn("progress", prog)
          .groupBy("model", "ablation", "benchmark").pivot("mode", PIVOT_MODES)
          .agg(F.first("accuracy_mean").alias("acc"), F.first("progress").alias("progress")))  # one run a cell
    sk = _skeleton(rows.sparkSession, models)
    out = sk.join(F.broadcast(pv), ["model", "ablation", "benchmark"], "left")
    g, c = F.col("cotgen_acc"), F.col("cotcond_acc")
    delta = F.when(g.isNotNull() & c.isNotNull() & (g != 0), (c - g) / g * 100)
    return out.select("model", "ablation", "benchmark",
                      *[F.col(f"{m}_{k}") for m in PIVOT_MODES for k in ("acc", "progress")],
                      delta.alias("delta_cotcond_vs_cotgen_pct"))


def memory_peak(samples: DataFrame, run_col: str = "run_id", ts_col: str = "sample_ts",
                mem_col: str = "mem") -> DataFrame:
    """Per run, the maximum over samples of memory summed across GPUs;
    a sample with any failed (NULL) reading is skipped; 0 -> NULL."""
    per = samples.groupBy(run_col, ts_col).agg(
        F.sum(mem_col).alias("total"), F.count_if(F.col(mem_col).isNull()).alias("n_fail"))
    valid = F.col("n_fail") == 0
    g = per.groupBy(run_col).agg(F.max(F.when(valid, F.col("total"))).alias("peak"),
                                 F.count_if(valid).cast("long").alias("num_samples"))
    return g.select(run_col, F.when(F.col("peak") > 0, F.col("peak")).alias("peak_gpu_memory_mib_total"),
                    "num_samples")
