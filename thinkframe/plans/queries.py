"""The registered queries: each takes ``(spark, sf_dir)`` and returns a
DataFrame built from the driver tables through the library's operators.
Outputs are flat with aliased columns; doubles derived from averages are
rounded to 9 digits so independent engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as tf
from .. import schemas
from ..functions import staged
from ..constants import EVAL_MODEL_FAMILIES, FINAL_TABLE_FIELDS, TRAIN_FAMILIES, TRAIN_SUMMARY_FIELDS
from ..operators import evaluate, prepare, report, stats
from ..sources import benchmarks, families, fixtures
from ..sources.families import forced_assistant_prefix, think_tags
from ..session import scratch_path
from ..sinks import catalog_history, commit_catalog, write_csv_table, write_json_arrays, write_records, write_run_summaries, write_traces
from ..sources.examples import RAW_EXAMPLE_SCHEMA, load_examples, missing_fields
from ..sources.json_arrays import read_json_arrays
from ..sources.summaries import SPARK_SUMMARIES, load_eval_summaries, load_train_summaries
from ..sources.tables import read_table, stream_table
from ..streaming.memory import read_bounded_peaks, read_current_peaks, start_bounded_memory_stream, start_memory_stream
from ..streaming import stream_files
from ..streaming.rounds import read_folded_rounds, read_open_questions, start_round_stream
from ..streaming.run_summary import read_current_summary, start_run_summary_stream

DATASET = "s1k11_all_qwen3"
ROUND_FAMILY = "dsr1_llama8b"


def _round9(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), 9).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("long").alias(f.name)
                       if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name)
                       for f in df.schema.fields])


def _flat(df: DataFrame) -> DataFrame:
    return _round9(_longs(df))


# ---------------------------------------------------------------- preparation
def q_examples_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Required-field check (quarantine view) over F1 with injected NULLs."""
    ex = fixtures.with_injected_nulls(fixtures.raw_examples(spark, sf))
    m = missing_fields(ex)
    return _flat(m.select("ex_id", F.array_join("missing_fields", ",").alias("missing_fields"),
                          (F.size("missing_fields") == 0).alias("is_valid")))


def q_think_response(spark, sf):
    """P2 + S10: reasoning response for both training families over F1."""
    ex = fixtures.raw_examples(spark, sf)
    fams = F.array(*[F.struct(F.lit(k).alias("model_family"), F.lit(v[1]).alias("o"), F.lit(v[2]).alias("c"))
                     for k, v in TRAIN_FAMILIES.items()])
    x = ex.select("ex_id", "thinking", "answer", F.explode(fams).alias("f"))
    return _flat(x.select("ex_id", F.col("f.model_family").alias("model_family"),
                          tf.think_response(F.col("thinking"), F.col("answer"), F.col("f.o"), F.col("f.c"))
                          .alias("response")))


def _records(spark, sf, name=DATASET):
    return prepare.build_cot_data(fixtures.raw_examples(spark, sf), name, "qwen3")


def q_sharegpt_records(spark, sf):
    """P3, P4, J4, P16, E3 (+ T1): ShareGPT records for both modes and splits."""
    r = _records(spark, sf)
    conv = F.col("conversations")
    return _flat(r.select("ex_id", "dataset_key", "mode", "split", "system",
                          conv[0]["from"].alias("human_from"), conv[0]["value"].alias("human_value"),
                          conv[1]["from"].alias("gpt_from"), conv[1]["value"].alias("gpt_value")))


def q_holdout_split(spark, sf):
    """T1 + J6: exact seeded holdout over F1."""
    ex = fixtures.raw_examples(spark, sf)
    return _flat(prepare.holdout_split(ex).select("ex_id", "split"))


def _catalog_flat(cat: DataFrame) -> DataFrame:
    return _flat(cat.select(
        "dataset_key", "file_name", "formatting",
        F.col("columns")["messages"].alias("messages_column"), F.col("columns")["system"].alias("system_column"),
        F.col("tags")["role_tag"].alias("role_tag"), F.col("tags")["content_tag"].alias("content_tag"),
        F.col("tags")["user_tag"].alias("user_tag"), F.col("tags")["assistant_tag"].alias("assistant_tag"),
        "num_rows"))


def q_catalog_upsert(spark, sf):
    """K2: merge new catalog entries into an existing catalog."""
    # Both datasets are built from the same examples with the same seed, so the
    # split is computed once and the older dataset's keys are derived from it.
    recs = _records(spark, sf, DATASET)
    older = recs.withColumn("dataset_key", F.regexp_replace("dataset_key", "^" + DATASET, "s1k11_correct_only_qwen3"))
    old = (prepare.catalog_entries(older, "data/v1")
           .unionByName(prepare.catalog_entries(recs, "data/v1")))
    new = prepare.catalog_entries(recs, "data/v2")
    return _catalog_flat(prepare.upsert_catalog(old, new))


def q_catalog_versions(spark, sf):
    """K2: three builds publish their entries one after the other; the entries of every version.

    The builds' record counts come from F1; the second replaces the first one's location, the third is another dataset."""
    path = scratch_path(spark, "catalog")
    recs = _records(spark, sf, DATASET)
    other = recs.withColumn("dataset_key", F.regexp_replace("dataset_key", "^" + DATASET, "s1k11_correct_only_qwen3"))
    for entries in (prepare.catalog_entries(recs, "data/v1"), prepare.catalog_entries(recs, "data/v2"), prepare.catalog_entries(other, "data/v1")):
        commit_catalog(spark, path, entries)
    history = catalog_history(spark, path)
    return _flat(history.select("version", "dataset_key", "file_name", "formatting", F.col("columns")["messages"].alias("messages_column"),
                                F.col("tags")["role_tag"].alias("role_tag"), "num_rows"))


# -------------------------------------------------------------------- masking
def _masked(spark, sf):
    o, c = think_tags("qwen3")
    t = fixtures.token_arrays(spark, sf).select("ex_id", "variant", "token_texts", "labels")
    return staged.apply_think_mask(t, o, c)


def _mask_flat(m: DataFrame) -> DataFrame:
    lab = F.col("masked_labels")
    return _flat(m.select(
        "ex_id", "variant", "mask_status", "mask_start", "mask_end",
        F.size(lab).alias("n_tokens"),
        F.size(F.filter(lab, lambda x: x == -100)).alias("n_ignored"),
        F.md5(F.array_join(F.transform(lab, lambda x: x.cast("string")), ",")).alias("labels_md5")))


def q_think_mask(spark, sf):
    """Reasoning-content loss mask over F9 token arrays."""
    return _mask_flat(_masked(spark, sf))


def q_think_mask_bytes(spark, sf):
    """A10-A13 over tokens of bytes that split characters (F10), as a byte-level tokenizer makes them."""
    o, c = think_tags("qwen3")
    return _mask_flat(staged.apply_think_mask(fixtures.token_bytes(spark, sf), o, c, "token_bytes"))


def q_mask_fail_open_audit(spark, sf):
    """Mask outcome counts per fixture variant."""
    m = _masked(spark, sf)
    width = F.coalesce(F.col("mask_end") - F.col("mask_start"), F.lit(0))
    g = m.groupBy("variant", "mask_status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(width).alias("n_masked_tokens"))
    return _flat(g)


# ------------------------------------------------------------------ benchmarks
def _benchmark_sources(spark, sf) -> dict:
    b = read_table(spark, sf, "benchmark")
    d = read_table(spark, sf, "documents")
    return {
        "aime24": b.select(F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("ID"),
                           F.col("text").alias("Problem"), F.length("text").alias("Answer"),
                           F.col("item_id").alias("pos")),
        "aime25": d.select(F.col("doc_id").alias("id"), F.col("text").alias("problem"),
                           F.col("n_chars").alias("answer"), F.col("doc_id").alias("pos")),
        "math500": d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("unique_id"),
                            F.col("text").alias("problem"), F.col("lang").alias("answer"),
                            F.col("doc_id").alias("pos")),
    }


def q_benchmark_union(spark, sf):
    """S2-S4 + S6: uniform benchmark rows from three source shapes."""
    u = benchmarks.load_benchmarks(_benchmark_sources(spark, sf))
    return _flat(u.select("benchmark", "pos", "id", "question", "reference",
                          F.col("choices").isNull().alias("no_choices")))


def _gpqa(spark, sf):
    raw = fixtures.multiple_choice(spark, sf)
    g = raw.select(F.col("pos"), F.col("id").alias("Record ID"), F.col("question").alias("Question"),
                   F.col("o0").alias("Correct Answer"), F.col("o1").alias("Incorrect Answer 1"),
                   F.col("o2").alias("Incorrect Answer 2"), F.col("o3").alias("Incorrect Answer 3"))
    return benchmarks.gpqa_diamond(g)


def q_choice_permutation(spark, sf):
    """S5 + A9: seeded choice permutation over F8."""
    g = _gpqa(spark, sf)
    ch = F.col("choices")
    return _flat(g.select("pos", "id", "reference", ch["A"].alias("choice_a"), ch["B"].alias("choice_b"),
                          ch["C"].alias("choice_c"), ch["D"].alias("choice_d")))


def q_format_questions(spark, sf):
    """A8 + P5: question text and chat message for all four benchmarks."""
    qs = benchmarks.load_benchmarks(_benchmark_sources(spark, sf)).unionByName(_gpqa(spark, sf))
    f = evaluate.questions_with_prompts(qs)
    return _flat(f.select("benchmark", "pos", "id", F.col("messages")[0]["role"].alias("role"),
                          F.col("messages")[0]["content"].alias("prompt_text")))


def q_generation_requests(spark, sf):
    """J8 + P9 + P12: round-0 generation requests, one per (repeat, question):
    formatted prompt, its length (whitespace words), the round-0 token budget
    for a qwen3 run and the per-repeat seed."""
    qs = evaluate.questions_with_prompts(benchmarks.load_benchmarks(_benchmark_sources(spark, sf)))
    qs = qs.select("benchmark", "pos", "id", tf.whitespace_token_count(F.col("prompt_text")).alias("prompt_words"))
    mml = families.required_max_model_len("qwen3", 32768)
    budget = evaluate.round_budget(F.lit(0), F.col("prompt_words"), F.lit(32768), F.lit(4000), F.lit(mml))
    qs = qs.withColumn("max_tokens", budget)            # per question, before the fan-out
    r = evaluate.repeat_questions(qs, 3)
    return _flat(r.select("benchmark", "pos", "id", "repeat", "prompt_words", "max_tokens",
                          evaluate.seed_for_repeat(F.col("repeat")).alias("seed")))


# ------------------------------------------------------------------ generation
def _folded(spark, sf, max_rounds=2, laid_by=None):
    return evaluate.fold_rounds(fixtures.generation_rounds(spark, sf), max_rounds, laid_by=laid_by)


def q_fold_rounds(spark, sf):
    """G1 + P7: fold F3 generation rounds per (repeat, question)."""
    return _flat(_folded(spark, sf))


def _family_rounds(spark, sf):
    """F3 rounds, families going round the questions, with each family's number of continuation rounds."""
    from ..sources.families import eval_family_dim
    fam = F.element_at(F.array(*[F.lit(f) for f in EVAL_MODEL_FAMILIES]),
                       (F.col("question_id") % len(EVAL_MODEL_FAMILIES) + 1).cast("int"))
    return fixtures.generation_rounds(spark, sf).withColumn("model_family", fam).join(
        eval_family_dim(spark).select("model_family", "max_continuation_rounds"), "model_family")


def _prompts(spark, sf):
    return fixtures.round_questions(spark, sf).select("question_id", F.col("question").alias("prompt"))


FAMILY_KEYS = ("repeat", "question_id", "model_family")


def q_continuation_worklist(spark, sf):
    """P8-P10 + S11: rows needing another round, with prompt and budget."""
    folded = evaluate.fold_rounds(_family_rounds(spark, sf), "max_continuation_rounds", keys=FAMILY_KEYS)
    wl = evaluate.continuation_worklist(folded, 1024, "model_family", _prompts(spark, sf), prompt_headroom=256)
    return _flat(wl)


def _streamed_rounds(spark, rounds, root, most, keys):
    """The rounds written to files, and these folded as a stream, some files a batch."""
    rounds.write.parquet(root + "/in")
    start_round_stream(stream_files(spark, root + "/in", rounds.schema, 4), root + "/out", root + "/checkpoint", most, keys).awaitTermination()
    return root + "/out"


def q_stream_fold_rounds(spark, sf):
    """G1 + P7 as a stream: F3 rounds from files in any order, folded in per-question state (equals fold_rounds)."""
    out = _streamed_rounds(spark, fixtures.generation_rounds(spark, sf), scratch_path(spark, "g1"), 2, ("repeat", "question_id"))
    return _flat(read_folded_rounds(spark, out).drop("is_closed"))


def q_stream_worklist(spark, sf):
    """P8-P10 as a stream: the questions whose state is still open, with prompt and budget of their next round (equals continuation_worklist)."""
    out = _streamed_rounds(spark, _family_rounds(spark, sf), scratch_path(spark, "p8"), "max_continuation_rounds", FAMILY_KEYS)
    return _flat(evaluate.continuation_worklist(read_open_questions(spark, out, FAMILY_KEYS), 1024, "model_family", _prompts(spark, sf), prompt_headroom=256))


# --------------------------------------------------------------------- grading
PREFIX_FAMILIES = ("qwen3", "dsr1_llama8b")


def q_split_think_answer(spark, sf):
    """A1: reasoning/answer split for two forced prefixes over F2."""
    r = fixtures.model_responses(spark, sf)
    fams = F.array(*[F.struct(F.lit(f).alias("model_family"), F.lit(forced_assistant_prefix(f)).alias("prefix"))
                     for f in PREFIX_FAMILIES])
    x = r.select("question_id", "response", F.explode(fams).alias("f"))
    s = staged.with_split_think_answer(x, F.col("f.prefix"), "response")
    return _flat(s.select("question_id", F.col("f.model_family").alias("model_family"), "thinking", "answer"))


def q_last_boxed(spark, sf):
    """A2: last balanced \\boxed{} over F2."""
    r = fixtures.model_responses(spark, sf)
    return _flat(staged.with_last_boxed(r, "response", "boxed").select("question_id", "boxed"))


def q_grade_math(spark, sf):
    """A1 + A3-A5: math grading of F2 answers."""
    r = fixtures.model_responses(spark, sf)
    a = staged.with_split_think_answer(r, "", "response")
    g = staged.with_grade_math(a, "answer", "reference")
    return _flat(g.select("question_id", "lang", "reference", "is_correct", "extracted"))


def q_grade_letter(spark, sf):
    """A6 + A7: letter grading and benchmark dispatch over F2 answers."""
    r = fixtures.model_responses(spark, sf)
    r = staged.with_split_think_answer(r, "", "response")
    even = F.col("question_id") % 2 == 0
    r = (r.withColumn("benchmark", F.when(even, F.lit("gpqa_diamond")).otherwise(F.lit("math500")))
         .withColumn("_ref", F.when(even, F.col("ref_letter")).otherwise(F.col("reference"))))
    # The letter grade against ref_letter on every row, and the dispatched grade.
    r = staged.with_grade_letter(r, "answer", "ref_letter", "letter_correct", "letter")
    r = staged.with_grade(r, "benchmark", "answer", "_ref")
    return _flat(r.select("question_id", "benchmark", "ref_letter", "letter_correct", "letter",
                          "is_correct", "extracted"))


def q_eval_traces(spark, sf):
    """G1 + J7 + A1 + A7 + A15 + A16: graded trace rows from F3 rounds."""
    folded = _folded(spark, sf, laid_by="question_id")
    qs = fixtures.round_questions(spark, sf)
    t = evaluate.grade_traces(folded, qs, "math500", ROUND_FAMILY)
    return _flat(t)


def q_eval_run_stats(spark, sf):
    """G1 -> J7 -> A1/A7 -> A15/A16 -> G2-G5: per-repeat statistics of one run
    over graded traces from F3 rounds (elapsed seconds per repeat: 10 + repeat)."""
    folded = _folded(spark, sf, laid_by="question_id")
    t = evaluate.grade_traces(folded, fixtures.round_questions(spark, sf), "math500", ROUND_FAMILY)
    t = t.withColumns({"dataset_name": F.lit("s1k11_all_dsr1_llama8b"), "mode": F.lit("cotgen"),
                       "run_id": F.lit("run1"), "elapsed_seconds": (F.lit(10) + F.col("repeat")).cast("double")})
    return _flat(stats.repeat_stats(t))


# ------------------------------------------------------------------ statistics
def _traces_f4(spark, sf, documents=None):
    t = fixtures.graded_traces(spark, sf, documents)
    return t.withColumn("reasoning_tokens_added", F.when(
        F.col("was_truncated"), F.greatest(F.lit(0), F.col("reasoning_tokens") - F.col("initial_reasoning_tokens"))))


def _per_repeat(spark, sf):
    return stats.repeat_stats(_traces_f4(spark, sf))


def q_repeat_stats(spark, sf):
    """Per-repeat statistics over F4."""
    return _flat(_per_repeat(spark, sf))


def q_repeat_stats_spread(spark, sf):
    """As repeat_stats, medians by a histogram of two levels, so that a run holding all rows spreads over tasks."""
    return _flat(stats.repeat_stats(_traces_f4(spark, sf), medians="histogram"))


def _summary_flat(s: DataFrame) -> DataFrame:
    return _flat(s.withColumn("repeats", F.array_join(F.transform("per_repeat", lambda x: x["repeat"].cast("string")), ","))
                 .drop("per_repeat"))


def q_run_summary(spark, sf):
    """Per-run summary over F4's repeats."""
    return _summary_flat(stats.run_summary(_per_repeat(spark, sf)))


def q_running_summary(spark, sf):
    """Q3: run statistics after each repeat."""
    return _flat(stats.running_summary(_per_repeat(spark, sf)))


def with_run_config(summary: DataFrame) -> DataFrame:
    """F5 run configuration, one value per run, derived from the run keys."""
    model = tf.parse_dataset_name(F.col("dataset_name"))["model"]
    bad_base = (F.col("mode") == "base") & (F.col("run_id") == "run3")
    bad_tuned = (F.col("mode") == "cotcond") & (F.col("benchmark") == "aime25") & (F.col("run_id") == "run2")
    ckpt = (F.when(bad_base, F.lit("ckpt/base"))
            .when(F.col("mode") == "base", F.lit(None).cast("string"))
            .when(bad_tuned, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("ckpt/"), F.col("run_id"))))
    return summary.withColumns({
        "model_family": model, "checkpoint_dir": ckpt, "max_new_tokens": F.lit(32768),
        "temperature": F.when(F.col("run_id") == "run2", F.lit(0.7)),
        "top_p": F.when((F.col("run_id") == "run3") & (F.col("benchmark") == "gpqa_diamond"), F.lit(0.9)),
        "output_dir": F.lit("eval_results")})


def eval_summaries(spark, sf) -> DataFrame:
    """evaluation run summaries (D11) from F4 and the run configuration."""
    s = stats.run_summary(_per_repeat(spark, sf), with_per_repeat=False)
    rec = stats.eval_summary_records(with_run_config(s))
    rn = tf.run_name("dataset_name", "mode", "benchmark", "run_id")
    return rec.withColumns({"file_name": F.concat(rn, F.lit("_summary.json")),
                            "source_path": F.concat(F.lit("eval_results/"), rn, F.lit("_summary.json"))})


def q_summary_records(spark, sf):
    """D11 assembly: run configuration fields of each summary record."""
    return _summary_records(eval_summaries(spark, sf))


def _summary_records(r: DataFrame) -> DataFrame:
    m = F.col("sampling_params")
    return _flat(r.select(*stats.RUN_KEYS, "model_family", "checkpoint_dir", "num_repeats",
                          "num_repeats_completed", "is_complete", "max_new_tokens", "continuation_max_new_tokens",
                          "max_continuation_rounds", "trace_file", m["temperature"].alias("temperature"),
                          m["top_p"].alias("top_p"), F.size(m).alias("num_params")))


def q_next_run_id(spark, sf):
    """G9 + A17 + P15: next auto run id per (dataset, mode, benchmark)."""
    return _flat(stats.next_run_id(eval_summaries(spark, sf)))


def q_run_metadata_check(spark, sf):
    """P11 + P12: checkpoint rule and effective sampling parameters."""
    s = evaluate.check_run_metadata(eval_summaries(spark, sf))
    m = F.col("sampling_params")
    return _flat(s.select("dataset_name", "mode", "benchmark", "run_id", "model_family", "metadata_error",
                          m["temperature"].alias("temperature"), m["top_p"].alias("top_p"),
                          m["top_k"].alias("top_k"), m["min_p"].alias("min_p"),
                          F.size(m).alias("num_params")))


# --------------------------------------------------------------------- reports
def _train_summaries(spark, sf):
    return report.train_run_summary(fixtures.train_run_logs(spark, sf))


def q_train_comparison(spark, sf):
    """P21 + A18 + P14 + Q5: training summaries as the flat comparison table."""
    s = _train_summaries(spark, sf)
    return _flat(report.flatten_train_summary(s).orderBy("source_path"))


def q_final_table(spark, sf):
    """J1 + Q2 + P13 + P17 + A14 + Q4: train x eval table."""
    return _flat(report.final_table(eval_summaries(spark, sf), _train_summaries(spark, sf)))


def q_missing_train_rows(spark, sf):
    """P20: non-base rows without training data."""
    f = report.final_table(eval_summaries(spark, sf), _train_summaries(spark, sf), sort=False)
    return _flat(report.missing_train_rows(f).select("model", "ablation", "training_method", "benchmark", "run_id"))


def q_best_run_per_cell(spark, sf):
    """Q1: best run per (model, ablation, benchmark, mode)."""
    return _flat(report.best_run_per_cell(report.eval_rows(eval_summaries(spark, sf))))


def q_mode_pivot(spark, sf):
    """Mode pivot with deltas."""
    return _flat(report.mode_pivot(report.eval_rows(eval_summaries(spark, sf)), EVAL_MODEL_FAMILIES))


def q_memory_peak(spark, sf):
    """Memory peak per run over F7 samples."""
    return _flat(report.memory_peak(fixtures.memory_samples(spark, sf)))


# ------------------------------------------------------------------- streaming
def q_stream_run_summary(spark, sf):
    """ST1: the documents table as a stream of graded traces (equals run_summary)."""
    root = scratch_path(spark, "st1")
    traces = _traces_f4(spark, sf, stream_table(spark, sf, "documents"))
    start_run_summary_stream(traces, root + "/out", root + "/checkpoint").awaitTermination()
    return _summary_flat(read_current_summary(spark, root + "/out"))


def q_stream_summary_files(spark, sf):
    """ST1 + K5: the documents table as a stream of graded traces; the summary files of the runs, read back (equals run_summary)."""
    root = scratch_path(spark, "k5")
    traces = _traces_f4(spark, sf, stream_table(spark, sf, "documents", 1))
    start_run_summary_stream(traces, root + "/out", root + "/checkpoint", summaries_dir=root + "/summaries",
                             records=lambda s: stats.eval_summary_records(with_run_config(s))).awaitTermination()
    back = load_eval_summaries(spark, [root + "/summaries"], SPARK_SUMMARIES)
    return _summary_flat(back.drop("model_family", "checkpoint_dir", "max_samples", "sampling_params", "max_new_tokens", "continuation_max_new_tokens",
                                   "max_continuation_rounds", "trace_file", "source_path"))


def q_stream_memory_peak_bounded(spark, sf):
    """ST2: the events table as a stream of memory samples that closes a sample when the newest reading is two days past it.

    Files come in the order of their times, as a sampler writes them. Closed samples and those still open make the peaks (equals memory_peak)."""
    root = scratch_path(spark, "st2b")
    samples = fixtures.memory_samples(spark, sf, stream_table(spark, sf, "events"))
    start_bounded_memory_stream(samples, root + "/out", root + "/checkpoint", "2 days").awaitTermination()
    return _flat(read_bounded_peaks(spark, root + "/out", root + "/checkpoint"))


def q_stream_memory_peak(spark, sf):
    """ST2: the events table as a stream of memory samples (equals memory_peak)."""
    root = scratch_path(spark, "st2")
    samples = fixtures.memory_samples(spark, sf, stream_table(spark, sf, "events"))
    start_memory_stream(samples, root + "/out", root + "/checkpoint").awaitTermination()
    return _flat(read_current_peaks(spark, root + "/out"))


# ------------------------------------------------- written and read back again
def q_examples_roundtrip(spark, sf):
    """S1 + P1: F1 with NULLs as JSON lines, read through the example reader and checked."""
    path = scratch_path(spark, "examples") + ".jsonl"
    fixtures.with_injected_nulls(fixtures.raw_examples(spark, sf)).write.json(path)
    m = missing_fields(load_examples(spark, path))
    return _flat(m.select(F.col("ex_id").cast("long").alias("ex_id"), F.array_join("missing_fields", ",").alias("missing_fields"),
                          (F.size("missing_fields") == 0).alias("is_valid")))


def q_examples_json_array(spark, sf):
    """S1 + K1: F1 with NULLs as JSON arrays, a few large files, each cut into pieces of 1 MB and read as whole objects again."""
    path = scratch_path(spark, "arrays")
    write_json_arrays(fixtures.with_injected_nulls(fixtures.raw_examples(spark, sf)).coalesce(4), path)
    m = missing_fields(read_json_arrays(spark, path, RAW_EXAMPLE_SCHEMA, 1_000_000))
    return _flat(m.select(F.col("ex_id").cast("long").alias("ex_id"), "prompt", "thinking", "answer",
                          F.array_join("missing_fields", ",").alias("missing_fields")))


def q_records_roundtrip(spark, sf):
    """K1: records of two datasets written one after the other into one folder and read back."""
    path = scratch_path(spark, "records")
    recs = _records(spark, sf)
    write_records(recs, path)
    write_records(recs.withColumn("dataset_key", F.regexp_replace("dataset_key", "^" + DATASET, "s1k11_correct_only_qwen3")), path)
    back = spark.read.schema(T.StructType([*schemas.CONVERSATION_RECORD, T.StructField("dataset_key", T.StringType())])).json(path)
    conv = F.col("conversations")
    return _flat(back.select("dataset_key", "system", conv[0]["from"].alias("human_from"), conv[0]["value"].alias("human_value"),
                             conv[1]["from"].alias("gpt_from"), conv[1]["value"].alias("gpt_value")))


def q_traces_roundtrip(spark, sf):
    """K4: graded traces appended to a folder and read back."""
    path = scratch_path(spark, "traces")
    t = q_eval_traces(spark, sf)
    write_traces(t, path)
    return spark.read.schema(t.schema).json(path).select(*t.columns)


def q_eval_summaries_roundtrip(spark, sf):
    """K5 + S8 + E2: run summaries written to two folders, read from these and a missing one."""
    path = scratch_path(spark, "summaries")
    s = eval_summaries(spark, sf)
    first = F.col("run_id") == "run1"
    write_run_summaries(s.where(first), path + "/a")
    write_run_summaries(s.where(~first), path + "/b")
    back = load_eval_summaries(spark, [path + "/a", path + "/b", path + "/none"], SPARK_SUMMARIES)
    return _summary_records(back)


def q_train_summaries_roundtrip(spark, sf):
    """S7 + S9 + P14 + K3: training summaries as JSON files, read, flattened, written as the CSV and read back."""
    path = scratch_path(spark, "train")
    _train_summaries(spark, sf).select(*[f.name for f in schemas.TRAIN_SUMMARY]).write.json(path + "/json")
    flat = report.flatten_train_summary(load_train_summaries(spark, path + "/json", "*.json"))
    write_csv_table(flat, path + "/csv", TRAIN_SUMMARY_FIELDS, ["source_path"])
    table = flat.select(*TRAIN_SUMMARY_FIELDS)
    return _flat(spark.read.schema(table.schema).option("header", True).csv(path + "/csv"))


def q_final_table_csv(spark, sf):
    """K6: the train x eval table written as CSV and read back."""
    path = scratch_path(spark, "final")
    table = report.final_table(eval_summaries(spark, sf), _train_summaries(spark, sf))
    write_csv_table(table, path, FINAL_TABLE_FIELDS)
    return _flat(spark.read.schema(table.schema).option("header", True).csv(path))


def q_first_questions(spark, sf):
    """The first five questions of each benchmark, the feature of a limited run."""
    qs = benchmarks.load_benchmarks(_benchmark_sources(spark, sf))
    return _flat(evaluate.first_n_questions(qs, 5).select("benchmark", "pos", "id", "question", "reference"))


def q_eval_row_defaults(spark, sf):
    """Summaries of an older form, without the completeness fields, take the defaults."""
    old = F.col("run_id") != "run2"
    s = eval_summaries(spark, sf).withColumns({
        "is_complete": F.when(~old, F.col("is_complete")), "num_repeats_completed": F.when(~old, F.col("num_repeats_completed"))})
    return _flat(report.eval_rows(s))


QUERIES = {
    "examples_required_fields": q_examples_required_fields,
    "think_response": q_think_response,
    "sharegpt_records": q_sharegpt_records,
    "holdout_split": q_holdout_split,
    "catalog_upsert": q_catalog_upsert,
    "catalog_versions": q_catalog_versions,
    "think_mask": q_think_mask,
    "think_mask_bytes": q_think_mask_bytes,
    "mask_fail_open_audit": q_mask_fail_open_audit,
    "benchmark_union": q_benchmark_union,
    "choice_permutation": q_choice_permutation,
    "format_questions": q_format_questions,
    "generation_requests": q_generation_requests,
    "fold_rounds": q_fold_rounds,
    "continuation_worklist": q_continuation_worklist,
    "split_think_answer": q_split_think_answer,
    "last_boxed": q_last_boxed,
    "grade_math": q_grade_math,
    "grade_letter": q_grade_letter,
    "eval_traces": q_eval_traces,
    "eval_run_stats": q_eval_run_stats,
    "repeat_stats": q_repeat_stats,
    "repeat_stats_spread": q_repeat_stats_spread,
    "run_summary": q_run_summary,
    "running_summary": q_running_summary,
    "summary_records": q_summary_records,
    "next_run_id": q_next_run_id,
    "run_metadata_check": q_run_metadata_check,
    "train_comparison": q_train_comparison,
    "final_table": q_final_table,
    "missing_train_rows": q_missing_train_rows,
    "best_run_per_cell": q_best_run_per_cell,
    "mode_pivot": q_mode_pivot,
    "memory_peak": q_memory_peak,
    "stream_run_summary": q_stream_run_summary,
    "stream_memory_peak": q_stream_memory_peak,
    "stream_fold_rounds": q_stream_fold_rounds,
    "stream_worklist": q_stream_worklist,
    "stream_summary_files": q_stream_summary_files,
    "stream_memory_peak_bounded": q_stream_memory_peak_bounded,
    "examples_roundtrip": q_examples_roundtrip,
    "examples_json_array": q_examples_json_array,
    "records_roundtrip": q_records_roundtrip,
    "traces_roundtrip": q_traces_roundtrip,
    "eval_summaries_roundtrip": q_eval_summaries_roundtrip,
    "train_summaries_roundtrip": q_train_summaries_roundtrip,
    "final_table_csv": q_final_table_csv,
    "first_questions": q_first_questions,
    "eval_row_defaults": q_eval_row_defaults,
}
