"""Command-level flows: the data work of each command of the original tool,
as functions over Spark (read -> operators -> write). Each returns the
DataFrame it wrote so callers can inspect or reuse it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import (DEFAULT_EVAL_RESULTS_DIRS, DEFAULT_SEED, DEFAULT_SYSTEM_PROMPT, DEFAULT_TRAIN_RESULTS_DIR,
                         DEFAULT_VAL_FRACTION, EVAL_MODEL_FAMILIES, FINAL_TABLE_FIELDS, MODES, TRAIN_SUMMARY_FIELDS)
from ..operators import evaluate, prepare, report, stats
from ..sinks import commit_catalog, read_catalog, write_csv_table, write_records, write_run_summaries, write_traces
from ..sinks.files import empty_folder
from ..sources.examples import check_required, load_examples
from ..sources.summaries import load_eval_summaries, load_train_summaries


def build_data(spark: SparkSession, input_path: str, out_dir: str, dataset_name: str, catalog_path: str,
               model_family: str = "qwen3", val_input: str | None = None,
               val_fraction: float = DEFAULT_VAL_FRACTION, system_prompt: str = DEFAULT_SYSTEM_PROMPT,
               seed: int = DEFAULT_SEED) -> DataFrame:
    """S1 + P1 (strict) + T1 + P2-P4 + J4 + K1 + K2: build both modes'
    train/val records, write them per dataset key, and publish their entries
    as the catalog's next version (existing keys of other datasets are kept, also those of builds that run
    at the same time). The rows of each key are counted while they are written; a key without rows gets an
    empty folder. Returns the catalog as of this build."""
    raw = check_required(load_examples(spark, input_path), "strict")
    val = check_required(load_examples(spark, val_input), "strict") if val_input else None
    recs = prepare.build_cot_data(raw, dataset_name, model_family, val, val_fraction, system_prompt, seed)
    keys = [f"{dataset_name}_{mode}_{split}" for mode in MODES for split in ("train", "val")]
    written = Observation("rows by key")
    write_records(recs.observe(written, *[F.count_if(F.col("dataset_key") == k).alias(k) for k in keys]), out_dir)
    counts = written.get
    for k in keys:
        if not counts[k]:
            empty_folder(spark, f"{out_dir.rstrip('/')}/dataset_key={k}")
    new = prepare.counted_entries(spark, counts, out_dir, os.path.dirname(catalog_path.rstrip("/")))
    return read_catalog(spark, catalog_path, commit_catalog(spark, catalog_path, new))


def summarize_training(spark: SparkSession, results_dir: str, out_csv: str) -> DataFrame:
    """S9 + P14 + Q5 + K3: one CSV row per training summary, sorted by path."""
    flat = report.flatten_train_summary(load_train_summaries(spark, results_dir))
    write_csv_table(flat, out_csv, TRAIN_SUMMARY_FIELDS, ["source_path"])
    return flat


def build_final_table(spark: SparkSession, train_results_dir: str, eval_results_dirs, out_csv: str):
    """S7 + S8 + J1 + Q2 + P13 + P17 + Q4 + K6 + P20: the train x eval table.
    Returns ``(table, missing_train_count)``."""
    final = report.final_table(load_eval_summaries(spark, eval_results_dirs),
                               load_train_summaries(spark, train_results_dir))
    write_csv_table(final, out_csv, FINAL_TABLE_FIELDS)
    return final, report.missing_train_rows(final).count()


def default_dirs(root: str) -> tuple[str, list[str]]:
    """Training-results folder and evaluation-results folders under a project root."""
    r = root.rstrip("/")
    return f"{r}/{DEFAULT_TRAIN_RESULTS_DIR}", [f"{r}/{d}" for d in DEFAULT_EVAL_RESULTS_DIRS]


def build_pivot_table(spark: SparkSession, eval_results_dirs, models=None, out_csv: str | None = None,
                      show: bool = False) -> DataFrame:
    """S8 + Q1 + J2-J5 + E1 + G10 + P18 + P19 (+ K6 when ``out_csv``). With
    ``show`` the grid (len(models) x 8 rows) is printed to the console."""
    models = list(models or EVAL_MODEL_FAMILIES)
    pv = report.mode_pivot(report.eval_rows(load_eval_summaries(spark, eval_results_dirs)), models)
    if out_csv:
        write_csv_table(pv, out_csv)
    if show:
        pv.orderBy("model", "ablation", "benchmark").show(len(models) * 8, truncate=False)
    return pv


def evaluate_rounds(rounds: DataFrame, questions: DataFrame, runs: DataFrame, benchmark: str, model_family: str,
                    repeat_elapsed: DataFrame, out_dir: str | None = None, num_repeats: int = 3):
    """G1 + J7 + A1 + A7 + A15 + A16 + G2-G8 + D11 (+ K4, K5): generation
    rounds of one run -> trace rows, per-repeat statistics and the run
    summary record.

    ``rounds`` has the run keys, ``repeat``, ``question_id``, ``round``,
    ``text``, token counts and ``finish_reason``; ``repeat_elapsed`` gives
    ``elapsed_seconds`` per (run, repeat); ``runs`` is the run configuration
    (see ``eval_summary_records``). Returns ``(traces, per_repeat, summary)``.
    """
    keys = list(stats.RUN_KEYS)
    maxr = evaluate.eval_family(model_family)[7]
    folded = evaluate.fold_rounds(rounds, maxr, keys=(*[k for k in keys if k != "benchmark"], "repeat", "question_id"), laid_by="question_id")
    traces = evaluate.grade_traces(folded, questions, benchmark, model_family)
    traces = traces.join(repeat_elapsed, [*[k for k in keys if k != "benchmark"], "repeat"], "left")
    per_repeat = stats.repeat_stats(traces, keys)
    summary = stats.eval_summary_records(stats.run_summary(per_repeat, keys, num_repeats), runs)
    if out_dir:
        write_traces(traces, out_dir.rstrip("/") + "/traces")
        write_run_summaries(summary, out_dir.rstrip("/") + "/summaries")
    return traces, per_repeat, summary
