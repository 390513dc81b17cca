"""ST1 and K5: incremental run summary over trace files.

The stream keeps per-(run, repeat) statistics (G2-G5) as a stateful
aggregation in update mode: one state row per run and repeat, not per trace.
Each micro-batch lands only the (run, repeat) rows that it changed; a reader
folds the latest of each into the summaries (G6-G8). With a summary folder every batch also
rewrites the summary files of the runs it touched, as an evaluation does after each repeat.
A restarted query resumes from its checkpoint. No watermark is needed:
late rows simply update their repeat. The exact medians (G4) keep one
state entry per distinct token count, which a model's context length bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.stats import RUN_KEYS, repeat_stats, run_summary
from ..sinks.writers import write_run_summaries
from . import COMPACT_EVERY, batch_rows, landed, latest, write_changes


def start_run_summary_stream(traces: DataFrame, out_dir: str, checkpoint: str, run_keys=RUN_KEYS, summaries_dir: str | None = None,
                             records: Callable[[DataFrame], DataFrame] | None = None, num_repeats: int = 3, compact_every: int = COMPACT_EVERY):
    """Start the stream over ``traces`` (graded trace rows).

    With ``summaries_dir`` the summary of every run that a batch touches is written there (one folder a run, see ``write_run_summaries``),
    computed over all its repeats that have landed by then. ``records`` adds the run configuration (e.g. ``eval_summary_records``).
    A batch that is retried writes the same files again.
    """
    spark, fold = traces.sparkSession, latest((*run_keys, "repeat"))

    def rewrite(batch_id: int) -> None:
        touched = batch_rows(spark, out_dir, batch_id).select(*run_keys).distinct()
        if touched.isEmpty():
            return
        repeats = landed(spark, out_dir, fold, batch_id).join(touched, list(run_keys), "left_semi")
        summary = run_summary(repeats, run_keys, num_repeats)
        write_run_summaries(records(summary) if records else summary, summaries_dir)

    return write_changes(repeat_stats(traces, run_keys), out_dir, checkpoint, fold, after=rewrite if summaries_dir else None, compact_every=compact_every)


def read_current_summary(spark: SparkSession, out_dir: str, run_keys=RUN_KEYS, num_repeats: int = 3) -> DataFrame:
    """Run summaries over the repeats that have landed."""
    return run_summary(landed(spark, out_dir, latest((*run_keys, "repeat"))), run_keys, num_repeats)
