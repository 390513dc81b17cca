"""Record building, prompt formatting and name/time helpers
(P2, P3, P5, A8, P15, P16, A14, A17, A18, P21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (ABLATION_PREFIXES, BASE_DATASET_PREFIX, CHOICE_LETTERS, DATASET_PREFIX,
                         GPQA_DIRECTIVE, ISO_SECONDS_FORMAT, MATH_DIRECTIVE, RUN_ID_PREFIX)
from ._util import col, lit
from .text import py_strip


def think_response(thinking, answer, think_open, think_close) -> Column:
    """open + strip(thinking) + close + strip(answer)."""
    return F.concat(lit(think_open), py_strip(thinking), lit(think_close), py_strip(answer))


def conversation_record(human, gpt, system) -> Column:
    """ShareGPT record ``struct(system, conversations[{from, value}])``.
    Neither the prompt nor the system text is stripped."""
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), lit(v).alias("value"))
    return F.struct(lit(system).alias("system"),
                    F.array(turn("human", col(human)), turn("gpt", col(gpt))).alias("conversations"))


def format_question(benchmark, question, choices=None) -> Column:
    """Question text for the model.

    Math benchmarks: stripped question, blank line, directive. gpqa_diamond:
    stripped question, blank line, ``A) ..`` to ``D) ..`` (options not
    stripped), blank line, directive. Any other benchmark raises.
    """
    b = lit(benchmark)
    math = F.concat(py_strip(question), F.lit("\n\n" + MATH_DIRECTIVE))
    if choices is None:
        gpqa = F.raise_error(F.lit("gpqa_diamond questions need choices"))
    else:
        ch = col(choices)
        opts = [F.concat(F.lit(f"{L}) "), F.element_at(ch, F.lit(L))) for L in CHOICE_LETTERS]
        gpqa = F.concat_ws("\n", py_strip(question), F.lit(""), *opts, F.lit(""), F.lit(GPQA_DIRECTIVE))
    return (F.when(b.isin("aime24", "aime25", "math500"), math)
            .when(b == "gpqa_diamond", gpqa)
            .otherwise(F.raise_error(F.concat(F.lit("unknown benchmark: "), b))))


def dataset_key(name, mode, split) -> Column:
    """``{name}_{mode}_{split}`` (arguments are columns or column names)."""
    return F.concat_ws("_", col(name), col(mode), col(split))


def run_name(dataset_name, mode, benchmark, run_id) -> Column:
    """``{dataset}_{mode}_{benchmark}_{run_id}`` (columns or column names)."""
    return F.concat_ws("_", col(dataset_name), col(mode), col(benchmark), col(run_id))


def parse_dataset_name(name, prefix: str = DATASET_PREFIX, on_error: str = "raise") -> Column:
    """``struct(model, ablation)``: ``base_X`` -> (X, base);
    ``{prefix}correct_only_X`` -> (X, correct_only); ``{prefix}all_X`` -> (X, all).

    ``on_error="raise"`` fails the query on other names; ``"null"`` returns
    NULL fields so the caller can quarantine them.
    """
    n = col(name)
    rest = lambda p: n.substr(F.lit(len(p) + 1), F.lit(2147483647))
    model = F.when(n.startswith(BASE_DATASET_PREFIX), rest(BASE_DATASET_PREFIX))
    ablation = F.when(n.startswith(BASE_DATASET_PREFIX), F.lit("base"))
    for head, label in ABLATION_PREFIXES:
        model = model.when(n.startswith(prefix + head), rest(prefix + head))
        ablation = ablation.when(n.startswith(prefix + head), F.lit(label))
    if on_error == "raise":
        bad = F.raise_error(F.concat(F.lit("unrecognized dataset_name: "), n))
        model = F.when(ablation.isNull(), bad).otherwise(model)
    return F.struct(model.alias("model"), ablation.alias("ablation"))


def iso_seconds(ts) -> Column:
    """UTC timestamp as ``YYYY-MM-DDTHH:MM:SSZ`` (session time zone must be UTC)."""
    return F.date_format(col(ts), ISO_SECONDS_FORMAT)


def duration_text(seconds) -> Column:
    """``{h}h{m}m{s}s`` for a whole number of seconds."""
    s = col(seconds).cast("long")
    return F.format_string("%dh%dm%ds", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)
