"""Explicit schemas for the data model (D1-D14). Reading JSON with these
avoids inference and makes a missing key read as NULL."""

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _f(name, t, nullable=True):
    return T.StructField(name, t, nullable)


CONVERSATION_RECORD = T.StructType([
    _f("system", S),
    _f("conversations", T.ArrayType(T.StructType([_f("from", S), _f("value", S)]))),
])

TRAIN_RESULTS = T.StructType([
    _f("train_runtime", D), _f("train_samples_per_second", D), _f("train_steps_per_second", D),
    _f("train_loss", D), _f("total_flos", D), _f("eval_loss", D), _f("num_input_tokens_seen", L),
])

TRAIN_SUMMARY = T.StructType([
    _f("dataset_name", S), _f("mode", S), _f("gpu_ids", S), _f("num_gpus", L), _f("config", S),
    _f("output_dir", S), _f("status", S), _f("start_time", S), _f("end_time", S),
    _f("wall_clock_seconds", L), _f("peak_gpu_memory_mib_total", D), _f("train_results", TRAIN_RESULTS),
])

PER_REPEAT = T.StructType([
    _f("repeat", I), _f("accuracy", D), _f("accuracy_excl_extended", D), _f("num_correct", L),
    _f("num_correct_excl_extended", L), _f("num_extended", L), _f("num_extended_correct", L),
    _f("num_extended_incorrect", L), _f("extended_accuracy", D), _f("num_still_truncated", L),
    _f("num_questions", L), _f("elapsed_seconds", D), _f("total_prompt_tokens", L),
    _f("total_output_tokens", L), _f("input_tokens_per_sec", D), _f("output_tokens_per_sec", D),
    _f("queries_per_sec", D), _f("mean_reasoning_tokens", D), _f("median_reasoning_tokens", D),
    _f("mean_extended_reasoning_tokens_added", D), _f("median_extended_reasoning_tokens_added", D),
])

EVAL_SUMMARY = T.StructType([
    _f("dataset_name", S), _f("mode", S), _f("model_family", S), _f("benchmark", S), _f("run_id", S),
    _f("checkpoint_dir", S), _f("num_repeats", L), _f("num_repeats_completed", L), _f("is_complete", B),
    _f("num_questions", L), _f("max_samples", L), _f("sampling_params", T.MapType(S, D)),
    _f("max_new_tokens", L), _f("continuation_max_new_tokens", L), _f("max_continuation_rounds", L),
    _f("total_wall_clock_seconds", D), _f("per_repeat", T.ArrayType(PER_REPEAT)),
    _f("accuracy_mean", D), _f("accuracy_std", D), _f("accuracy_mean_excl_extended", D),
    _f("accuracy_std_excl_extended", D), _f("num_extended_total", L), _f("num_extended_correct_total", L),
    _f("num_extended_incorrect_total", L), _f("extended_accuracy_mean", D),
    _f("num_still_truncated_total", L), _f("mean_extended_reasoning_tokens_added_mean", D),
    _f("output_tokens_per_sec_mean", D), _f("input_tokens_per_sec_mean", D),
    _f("queries_per_sec_mean", D), _f("mean_reasoning_tokens_mean", D), _f("trace_file", S),
])

ROUNDS = T.StructType([
    _f("question_id", S), _f("repeat", I), _f("round", I), _f("text", S),
    _f("prompt_tokens", L), _f("output_tokens", L), _f("finish_reason", S),
])

MEMORY_SAMPLE = T.StructType([
    _f("run_id", S), _f("gpu", S), _f("sample_ts", T.TimestampType()), _f("mem", D),
])
