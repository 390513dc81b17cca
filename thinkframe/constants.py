"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a literal the results depend on (tag strings,
family settings, prompt directives, column lists, enum values). They are kept
together, in natural order, so they can be checked at a glance.
"""

# --- Fixed values: reasoning tags used when building training data ---------
DEFAULT_THINK_OPEN = "<think>\n"
DEFAULT_THINK_CLOSE = "\n</think>\n\n"

# --- Fixed values: tags used to split a generated response -----------------
EVAL_THINK_OPEN = "<think>"
EVAL_THINK_CLOSE = "</think>"

# --- Fixed values: label value ignored by the loss ------------------------
IGNORE_INDEX = -100

# --- Fixed values: training-side model families ----------------------------
# name: (template, think_open, think_close)
TRAIN_FAMILIES = {
    "qwen3": ("qwen3", "<think>\n", "\n</think>\n\n"),
    "gemma4": ("gemma4", "<|channel>thought\n", "<channel|>"),
}

# --- Fixed values: evaluation-side model families --------------------------
# name: (template, base_model, forced_prefix, enable_thinking,
#        sampling_params, recommended_max_new_tokens, native_max_context,
#        max_continuation_rounds, continuation_max_new_tokens_override)
EVAL_FAMILIES = {
    "qwen3": ("qwen3", "Qwen/Qwen3-8B", "", True,
              {"temperature": 0.6, "top_p": 0.95, "top_k": 20, "min_p": 0.0},
              32768, 40960, 1, 4000),
    "dsr1_llama8b": ("deepseekr1", "deepseek-ai/DeepSeek-R1-Distill-Llama-8B", "<think>\n", False,
                     {"temperature": 0.6, "top_p": 0.95},
                     32768, 131072, 2, None),
    "dsr1_qwen7b": ("deepseekr1", "deepseek-ai/DeepSeek-R1-Distill-Qwen-7B", "<think>\n", False,
                    {"temperature": 0.6, "top_p": 0.95},
                    32768, 131072, 2, None),
    "qwen3_0p6b": ("qwen3", "Qwen/Qwen3-0.6B", "", True,
                   {"temperature": 0.6, "top_p": 0.95, "top_k": 20, "min_p": 0.0},
                   32768, 40960, 1, 4000),
    "qwen3_4b": ("qwen3", "Qwen/Qwen3-4B", "", True,
                 {"temperature": 0.6, "top_p": 0.95, "top_k": 20, "min_p": 0.0},
                 32768, 40960, 1, 4000),
}
EVAL_MODEL_FAMILIES = ["qwen3", "dsr1_llama8b", "dsr1_qwen7b", "qwen3_0p6b", "qwen3_4b"]

# --- Fixed values: data building ------------------------------------------
REQUIRED_FIELDS = ["prompt", "thinking", "answer"]
MODES = ["cotgen", "cotcond"]
DEFAULT_SYSTEM_PROMPT = "You are a careful, helpful assistant."
DEFAULT_SEED = 12345
DEFAULT_VAL_FRACTION = 0.02
CATALOG_FORMATTING = "sharegpt"
CATALOG_COLUMNS = {"messages": "conversations", "system": "system"}
CATALOG_TAGS = {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt"}

# --- Fixed values: benchmarks and prompts ----------------------------------
BENCHMARKS = ["aime24", "aime25", "math500", "gpqa_diamond"]
MATH_DIRECTIVE = "Please reason step by step, and put your final answer within \\boxed{}."
GPQA_DIRECTIVE = ("Think step by step, then give your final answer as a single "
                  "letter (A, B, C, or D) within \\boxed{}, e.g. \\boxed{A}.")
CHOICE_LETTERS = ["A", "B", "C", "D"]
CHOICE_SEED_PREFIX = "gpqa"
NUMERIC_TOLERANCE = 1e-6

# --- Fixed values: answer extraction and math normalisation -----------------
BOXED_MARK = "\\boxed{"
# removed in this order, after stripping whitespace
LATEX_REMOVALS = ["\\left", "\\right", "\\!", "\\,", "\\;", "\\text{}"]
TEXT_WRAPPER_PATTERN = r"\\text\{([^}]*)\}"     # \text{x} -> x
TRAILING_STRIP_CHARS = "."
EDGE_STRIP_CHARS = "$"

# --- Fixed values: evaluation run defaults ---------------------------------
DEFAULT_NUM_REPEATS = 3
DEFAULT_MAX_NEW_TOKENS = 32768
DEFAULT_SEED_BASE = 12345
PROMPT_HEADROOM = 4096
EVAL_MODES = ["base", "cotgen", "cotcond"]

# --- Fixed values: report tables -------------------------------------------
PIVOT_BENCHMARKS = ["aime24", "aime25", "math500", "gpqa_diamond"]
PIVOT_ABLATIONS = ["all", "correct_only"]
PIVOT_MODES = ["base", "cotgen", "cotcond"]
DATASET_PREFIX = "s1k11_"
BASE_DATASET_PREFIX = "base_"
ABLATION_PREFIXES = [("correct_only_", "correct_only"), ("all_", "all")]
RUN_ID_PREFIX = "run"
SUMMARY_SUFFIX = "_summary.json"
TRACES_SUFFIX = "_traces.jsonl"

FINAL_TABLE_FIELDS = [
    "model", "ablation", "training_method", "benchmark", "run_id",
    "num_eval_repeats", "num_eval_repeats_completed", "eval_is_complete",
    "train_total_flos", "train_runtime_seconds", "train_num_input_tokens_seen",
    "train_tokens_per_sec", "eval_accuracy_mean", "eval_accuracy_std",
    "eval_accuracy_mean_excl_extended", "eval_accuracy_std_excl_extended",
    "eval_num_extended_total", "eval_num_extended_correct_total",
    "eval_num_extended_incorrect_total", "eval_extended_accuracy_mean",
    "eval_num_still_truncated_total", "eval_mean_extended_reasoning_tokens_added",
    "eval_output_tokens_per_sec_mean", "eval_input_tokens_per_sec_mean",
    "eval_queries_per_sec_mean", "eval_mean_reasoning_tokens", "eval_num_questions",
]

TRAIN_SUMMARY_FIELDS = [
    "dataset_name", "mode", "status", "gpu_ids", "num_gpus",
    "start_time", "end_time", "wall_clock_seconds",
    "peak_gpu_memory_mib_total",
    "train_runtime", "train_samples_per_second", "train_steps_per_second",
    "train_loss", "total_flos",
    "eval_loss",
    "output_dir", "config",
]
TRAIN_RESULT_METRICS = ["train_runtime", "train_samples_per_second",
                        "train_steps_per_second", "train_loss", "total_flos", "eval_loss"]

ISO_SECONDS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# --- Fixed values: default result folders under a project root -------------
DEFAULT_TRAIN_RESULTS_DIR = "results"
DEFAULT_EVAL_RESULTS_DIRS = ["eval_results", "eval_results_notebook"]
MEMORY_SAMPLE_SECONDS = 5
