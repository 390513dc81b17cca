"""Per-repeat and per-run statistics.

Both levels are hash aggregations with partial (map-side) aggregation, so a
run holding a large share of all traces is pre-aggregated in every task
before the shuffle. The exact medians use Spark's percentile buffer, which
holds one entry per distinct value (token counts), not one per row, or a histogram that spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import DEFAULT_NUM_REPEATS, RUN_ID_PREFIX, SUMMARY_SUFFIX, TRACES_SUFFIX

RUN_KEYS = ("dataset_name", "mode", "benchmark", "run_id")


def _cnt(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def _joined(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & left[k].eqNullSafe(other[f"_{i}"])
    return left.join(other, match, how).drop(*[f"_{i}" for i in range(len(keys))])


def spread_median(rows: DataFrame, keys, value: Column, name: str) -> DataFrame:
    """(keys, ``name``): the exact median of an integer ``value`` in each group, by a histogram of two levels.

    Equal values are counted first, dealt by (keys, value). The range of a group's values is cut into about as many buckets as a
    bucket has values, the buckets are summed up in order to find those with the middle ranks, and only their values are
    looked at. So a group that holds all rows is counted by all tasks, and no task orders more than the square root of its range. Nulls
    count for nothing; a group without values has no row.
    """
    keys = list(keys)
    counted = rows.select(*keys, value.cast("long").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ends = counted.groupBy(*keys).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    width = F.ceil(F.sqrt(F.col("_max") - F.col("_min") + 1)).cast("long")
    counted = _joined(counted, ends.select(*keys, "_min", width.alias("_width")), keys, "inner")
    counted = counted.withColumn("_b", F.floor((F.col("_v") - F.col("_min")) / F.col("_width"))).drop("_min", "_width")
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).select(*keys, "_b", "_n", before.alias("_before"), F.sum("_n").over(group).alias("_all"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = buckets.where((F.col("_before") <= high) & (F.col("_before") + F.col("_n") > low)).select(*keys, "_b", "_before", low.alias("_low"), high.alias("_high"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _joined(counted, middle, [*keys, "_b"], "inner").withColumn("_at", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    held = ranked.where((F.col("_at") <= F.col("_high")) & (F.col("_at") + F.col("_n") > F.col("_low")))
    return held.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / F.lit(2.0)).alias(name))


def repeat_stats(traces: DataFrame, run_keys=RUN_KEYS, elapsed_col: str = "elapsed_seconds", medians: str = "buffer") -> DataFrame:
    """One row per (run, repeat).

    accuracy = correct / questions; accuracy_excl_extended counts extended
    (truncated-then-continued) rows as wrong; extended_accuracy is NULL
    without extended rows; throughput divides by the repeat's elapsed
    seconds (an input column); mean/median reasoning tokens (0 when empty),
    and mean/median of added reasoning tokens over extended rows only.

    ``medians="buffer"`` (the form for streams too) gathers the distinct token counts of a (run, repeat), which a model's context length
    bounds, in one task; ``"histogram"`` spreads them over tasks (``spread_median``). Both are exact.
    """
    ok, ext, still = F.col("is_correct"), F.col("was_truncated"), F.col("still_truncated")
    added = F.when(ext, F.col("reasoning_tokens_added"))
    of = {"median_reasoning_tokens": F.col("reasoning_tokens"), "median_extended_reasoning_tokens_added": added}
    g = traces.groupBy(*run_keys, "repeat").agg(
        F.count(F.lit(1)).cast("long").alias("num_questions"),
        _cnt(ok).alias("num_correct"),
        _cnt(ok & ~ext).alias("num_correct_excl_extended"),
        _cnt(ext).alias("num_extended"),
        _cnt(ext & ok).alias("num_extended_correct"),
        _cnt(ext & ~ok).alias("num_extended_incorrect"),
        _cnt(ext & still).alias("num_still_truncated"),
        F.sum("prompt_tokens").cast("long").alias("total_prompt_tokens"),
        F.sum("output_tokens").cast("long").alias("total_output_tokens"),
        F.max(elapsed_col).cast("double").alias("elapsed_seconds"),
        F.coalesce(F.avg("reasoning_tokens"), F.lit(0.0)).alias("mean_reasoning_tokens"),
        F.coalesce(F.avg(added), F.lit(0.0)).alias("mean_extended_reasoning_tokens_added"),
        *([F.coalesce(F.median(c), F.lit(0.0)).alias(n) for n, c in of.items()] if medians == "buffer" else []),
    )
    if medians == "histogram":
        for n, c in of.items():
            g = _joined(g, spread_median(traces, (*run_keys, "repeat"), c, n), (*run_keys, "repeat"), "left")
        g = g.fillna(0.0, list(of))
    e = F.col("elapsed_seconds")
    return g.select(
        *run_keys, "repeat",
        (F.col("num_correct") / F.col("num_questions")).alias("accuracy"),
        (F.col("num_correct_excl_extended") / F.col("num_questions")).alias("accuracy_excl_extended"),
        "num_correct", "num_correct_excl_extended", "num_extended", "num_extended_correct",
        "num_extended_incorrect",
        F.try_divide(F.col("num_extended_correct"), F.col("num_extended")).alias("extended_accuracy"),
        "num_still_truncated", "num_questions", "elapsed_seconds", "total_prompt_tokens", "total_output_tokens",
        F.try_divide(F.col("total_prompt_tokens"), e).alias("input_tokens_per_sec"),
        F.try_divide(F.col("total_output_tokens"), e).alias("output_tokens_per_sec"),
        F.try_divide(F.col("num_questions"), e).alias("queries_per_sec"),
        "mean_reasoning_tokens", "median_reasoning_tokens",
        "mean_extended_reasoning_tokens_added", "median_extended_reasoning_tokens_added",
    )


PER_REPEAT_FIELDS = [
    "repeat", "accuracy", "accuracy_excl_extended", "num_correct", "num_correct_excl_extended",
    "num_extended", "num_extended_correct", "num_extended_incorrect", "extended_accuracy",
    "num_still_truncated", "num_questions", "elapsed_seconds", "total_prompt_tokens",
    "total_output_tokens", "input_tokens_per_sec", "output_tokens_per_sec", "queries_per_sec",
    "mean_reasoning_tokens", "median_reasoning_tokens", "mean_extended_reasoning_tokens_added",
    "median_extended_reasoning_tokens_added",
]


def _summary_columns(num_repeats, of=lambda aggregate: aggregate) -> list[Column]:
    """The statistics of a run (G6, G8) over its repeats; ``of`` turns each plain aggregate into one over a window, say."""
    n = of(F.count(F.lit(1))).cast("long")
    target = F.lit(num_repeats) if isinstance(num_repeats, int) else of(F.first(num_repeats))

    def spread(column):
        return F.coalesce(of(F.stddev_samp(column)), F.lit(0.0))

    return [
        n.alias("num_repeats_completed"), (n >= target).alias("is_complete"),
        of(F.max("num_questions")).alias("num_questions"),
        of(F.sum("elapsed_seconds")).alias("total_wall_clock_seconds"),
        of(F.avg("accuracy")).alias("accuracy_mean"), spread("accuracy").alias("accuracy_std"),
        of(F.avg("accuracy_excl_extended")).alias("accuracy_mean_excl_extended"),
        spread("accuracy_excl_extended").alias("accuracy_std_excl_extended"),
        *[of(F.sum(c)).alias(c + "_total") for c in ("num_extended", "num_extended_correct", "num_extended_incorrect")],
        of(F.avg("extended_accuracy")).alias("extended_accuracy_mean"),
        of(F.sum("num_still_truncated")).alias("num_still_truncated_total"),
        *[of(F.avg(c)).alias(c + "_mean") for c in ("mean_extended_reasoning_tokens_added", "output_tokens_per_sec",
                                                    "input_tokens_per_sec", "queries_per_sec", "mean_reasoning_tokens")],
    ]


def run_summary(per_repeat: DataFrame, run_keys=RUN_KEYS, num_repeats=DEFAULT_NUM_REPEATS,
                with_per_repeat: bool = True) -> DataFrame:
    """One row per run over the repeats that landed.

    Means over repeats; sample standard deviations (0.0 with one repeat);
    totals; mean of the non-NULL extended accuracies (NULL if none);
    ``num_repeats_completed`` and ``is_complete`` (completed >= target);
    ``per_repeat`` is the nested, repeat-ordered list (G7, bounded by the
    number of repeats).
    """
    aggs = _summary_columns(num_repeats)
    if with_per_repeat:
        aggs.append(F.array_sort(F.collect_list(F.struct(*PER_REPEAT_FIELDS))).alias("per_repeat"))
    out = per_repeat.groupBy(*run_keys).agg(*aggs)
    if isinstance(num_repeats, int):
        out = out.withColumn("num_repeats", F.lit(num_repeats).cast("long"))
    return out


def running_summary(per_repeat: DataFrame, run_keys=RUN_KEYS, num_repeats: int = DEFAULT_NUM_REPEATS) -> DataFrame:
    """Q3: after each repeat, the run's summary over the repeats so far
    (what the summary file shows while a run is in flight): all of ``run_summary`` but the nested list, by
    the same rules, so the row of a run's last repeat equals it. A run is complete once as many repeats
    as asked for have landed, whichever they are."""
    w = Window.partitionBy(*run_keys).orderBy("repeat").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_repeat.select(*run_keys, "repeat", *_summary_columns(num_repeats, lambda c: c.over(w)))


def summary_run_number(file_name: Column, base: Column) -> Column:
    """N from ``{base}_runN_summary.json``; NULL for other names."""
    head = F.concat(base, F.lit("_" + RUN_ID_PREFIX))
    tail = SUMMARY_SUFFIX
    mid = file_name.substr(F.length(head) + 1, F.length(file_name) - F.length(head) - F.lit(len(tail)))
    ok = file_name.startswith(head) & file_name.endswith(tail) & mid.rlike(r"^[0-9]+$")
    return F.when(ok, mid.cast("long"))


def next_run_id(files: DataFrame, keys=("dataset_name", "mode", "benchmark"),
                file_col: str = "file_name") -> DataFrame:
    """Per (dataset, mode, benchmark) the next unused ``run{max+1}``
    (``run1`` when none); files not named ``{base}_runN_summary.json`` are
    ignored."""
    base = F.concat_ws("_", *[F.col(k) for k in keys])
    n = summary_run_number(F.col(file_col), base)
    g = files.groupBy(*keys).agg(F.max(n).alias("max_run"))
    return g.select(*keys, F.coalesce(F.col("max_run"), F.lit(0)).alias("max_run"),
                    F.concat(F.lit(RUN_ID_PREFIX), (F.coalesce(F.col("max_run"), F.lit(0)) + 1).cast("string"))
                    .alias("next_run_id"))


def eval_summary_records(summary: DataFrame, runs: DataFrame | None = None, run_keys=RUN_KEYS) -> DataFrame:
    """Per-run statistics joined with the run configuration.

    ``runs`` has one row per run: the run keys, ``model_family``,
    ``checkpoint_dir``, ``max_new_tokens``, optional ``temperature``,
    ``top_p``, ``max_samples``, ``continuation_max_new_tokens`` and
    ``max_continuation_rounds`` overrides, and ``output_dir``. Adds the
    effective ``sampling_params`` (P12), the continuation settings (S11
    defaults unless overridden) and ``trace_file``. Both sides hold one row
    per run; the family settings come from the 5-row broadcast dimension.
    With ``runs=None`` the configuration columns are read from ``summary``
    itself (no join).
    """
    from ..sources.families import eval_family_dim
    from .evaluate import effective_sampling_params

    src = summary if runs is None else runs

    def opt(c, t):
        return F.col(c) if c in src.columns else F.lit(None).cast(t)

    dim = eval_family_dim(src.sparkSession).select(
        "model_family", F.col("sampling_params").alias("_fam_params"),
        F.col("max_continuation_rounds").alias("_fam_rounds"),
        F.col("continuation_max_new_tokens_override").alias("_fam_cont"))
    r = src.join(dim, "model_family", "left")
    # An unknown family is an error, not a row without settings.
    r = r.withColumn("_fam_params", F.when(F.col("_fam_rounds").isNull() & F.col("model_family").isNotNull(), F.raise_error(
        F.concat(F.lit("no evaluation settings for family "), F.col("model_family")))).otherwise(F.col("_fam_params")))
    name = F.concat_ws("_", *[F.col(k) for k in run_keys])
    keep = [c for c in src.columns if c not in ("max_samples", "max_new_tokens", "continuation_max_new_tokens",
                                                "max_continuation_rounds", "output_dir")] if runs is None \
        else [*run_keys, "model_family", "checkpoint_dir"]
    cfg = r.select(
        *keep, opt("max_samples", "long").alias("max_samples"),
        effective_sampling_params(F.col("_fam_params"), opt("temperature", "double"), opt("top_p", "double"))
        .alias("sampling_params"),
        F.col("max_new_tokens").cast("long").alias("max_new_tokens"),
        F.coalesce(opt("continuation_max_new_tokens", "long"), F.col("_fam_cont"), F.col("max_new_tokens"))
        .cast("long").alias("continuation_max_new_tokens"),
        F.coalesce(opt("max_continuation_rounds", "long"), F.col("_fam_rounds")).cast("long")
        .alias("max_continuation_rounds"),
        F.concat(F.col("output_dir"), F.lit("/"), name, F.lit(TRACES_SUFFIX)).alias("trace_file"))
    return cfg if runs is None else summary.join(cfg, list(run_keys), "left")
