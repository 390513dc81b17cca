"""Evaluation: fold generation rounds (G1, P7), continuation work-list
(P8-P10), run metadata and sampling parameters (P11, P12), repeats x
questions (J8) and graded trace rows (J7, A1, A7, A15, A16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_SEED_BASE, PROMPT_HEADROOM
from ..functions.formatting import format_question
from ..functions.text import whitespace_token_count
from ..sources.families import eval_family

ROUND_KEYS = ("repeat", "question_id")


def fold_rounds(rounds: DataFrame, max_continuation_rounds, keys=ROUND_KEYS, laid_by: str | None = None) -> DataFrame:
    """G1: one row per (repeat, question) from per-round generations.

    Rounds above ``max_continuation_rounds`` and rounds after the first one
    that did not end in ``length`` are dropped. text = rounds concatenated
    in order; prompt tokens, initial text and initial output tokens come
    from round 0; output tokens are summed; ``was_truncated`` = round 0 hit
    the limit; ``still_truncated`` = the last kept round hit the limit. A key
    without round 0 or with a round twice is an error.

    One shuffle on the keys with a bounded ``collect_list`` (at most
    ``1 + max_continuation_rounds`` rounds per key after the pushed filter).
    ``max_continuation_rounds`` may be an int or a column of ``rounds``. With ``laid_by`` (one of ``keys``) that
    shuffle is by this key alone, so a later join on it, such as ``grade_traces`` with the questions, finds the folded texts where it needs
    them and moves them no second time. A key then holds a question's rounds of all repeats.
    """
    maxr = F.lit(max_continuation_rounds) if isinstance(max_continuation_rounds, int) else F.col(max_continuation_rounds)
    r = rounds.where(F.col("round") <= maxr)
    if laid_by:
        r = r.repartition(laid_by)
    st = F.struct("round", F.col("finish_reason").alias("fin"), "text", "output_tokens", "prompt_tokens")
    g = r.groupBy(*keys).agg(F.array_sort(F.collect_list(st)).alias("_rs"))
    rs = F.col("_rs")
    stop = F.array_position(F.transform(rs, lambda x: F.coalesce(x["fin"] != "length", F.lit(True))), True)
    kept = F.slice(rs, 1, F.when(stop > 0, stop).otherwise(F.size(rs)).cast("int"))
    first = F.element_at(F.col("_kept"), 1)
    out_tok = F.aggregate(F.col("_kept"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["output_tokens"], F.lit(0)))
    rounds = F.transform(rs, lambda x: x["round"])
    fault = (F.when(F.element_at(rounds, 1) != 0, F.lit("round 0 is missing"))
             .when(F.size(F.array_distinct(rounds)) < F.size(rounds), F.lit("a round occurs twice")))
    where = F.concat_ws(" ", *[F.concat(F.lit(k + "="), F.col(k).cast("string")) for k in keys])
    g = g.where(F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(" for "), where))).otherwise(F.lit(True)))
    g = g.withColumn("_kept", kept).withColumn("_out", out_tok)
    return g.select(
        *keys,
        F.array_join(F.transform("_kept", lambda x: x["text"]), "").alias("text"),
        first["text"].alias("initial_round_text"),
        first["prompt_tokens"].alias("prompt_tokens"),
        F.col("_out").alias("output_tokens"),
        first["output_tokens"].alias("initial_round_output_tokens"),
        (F.col("_out") - first["output_tokens"]).alias("continuation_output_tokens"),
        (first["fin"] == "length").alias("was_truncated"),
        (F.element_at(F.col("_kept"), -1)["fin"] == "length").alias("still_truncated"),
        F.size("_kept").alias("num_rounds"),
        F.element_at(F.col("_kept"), -1)["round"].alias("last_round"),
    )


def continuation_worklist(folded: DataFrame, max_new_tokens: int, model_family_col: str = "model_family",
                          prompts: DataFrame | None = None, prompt_key: str = "question_id",
                          prompt_headroom: int = PROMPT_HEADROOM) -> DataFrame:
    """P8-P10 with S11: rows that need another round.

    A row continues when its last round hit ``length`` and fewer than the
    family's ``max_continuation_rounds`` continuation rounds ran. The next
    prompt is the original prompt plus all text so far; its length in
    tokens is prompt tokens + output tokens so far. The per-row budget is
    ``min(round_max, max(1, max_model_len - prompt_len))`` with round_max
    the continuation budget (the next round is never round 0).
    """
    from ..sources.families import with_eval_family
    df = with_eval_family(folded, model_family_col, max_new_tokens=max_new_tokens, prompt_headroom=prompt_headroom)
    df = df.where(F.col("still_truncated") & (F.col("last_round") < F.col("max_continuation_rounds")))
    prompt_len = F.col("prompt_tokens") + F.col("output_tokens")
    budget = F.least(F.col("continuation_max_new_tokens"), F.greatest(F.lit(1), F.col("max_model_len") - prompt_len))
    if prompts is not None:
        df = df.join(prompts.select(F.col(prompt_key), F.col("prompt")), prompt_key, "left")
        nxt = F.concat(F.col("prompt"), F.col("text"))
    else:
        nxt = F.col("text")
    return df.select(
        *ROUND_KEYS, model_family_col,
        (F.col("last_round") + 1).alias("next_round"),
        nxt.alias("next_prompt"),
        prompt_len.alias("next_prompt_tokens"),
        F.col("max_model_len"),
        budget.cast("long").alias("max_tokens"))


def round_budget(round_idx: Column, prompt_len: Column, max_new_tokens: Column,
                 continuation_max_new_tokens: Column, max_model_len: Column) -> Column:
    """``min(round_max, max(1, max_model_len - prompt_len))``."""
    round_max = F.when(round_idx == 0, max_new_tokens).otherwise(continuation_max_new_tokens)
    return F.least(round_max, F.greatest(F.lit(1), max_model_len - prompt_len))


def check_run_metadata(runs: DataFrame, mode: str = "quarantine") -> DataFrame:
    """Mode 'base' must have no checkpoint, every other mode needs one.
    Adds ``metadata_error`` (NULL when fine); ``mode="strict"`` fails instead."""
    err = (F.when((F.col("mode") == "base") & F.col("checkpoint_dir").isNotNull(),
                  F.lit("base_with_checkpoint"))
           .when((F.col("mode") != "base") & F.col("checkpoint_dir").isNull(),
                 F.lit("checkpoint_missing")))
    if mode == "strict":
        return runs.where(F.when(err.isNotNull(), F.raise_error(err)).otherwise(F.lit(True))) \
                   .withColumn("metadata_error", F.lit(None).cast("string"))
    return runs.withColumn("metadata_error", err)


SAMPLING_KEYS = ("temperature", "top_p", "top_k", "min_p")


def effective_sampling_params(family_params: Column, temperature: Column, top_p: Column,
                              seed: Column | None = None) -> Column:
    """The family's map with temperature / top_p replaced where given
    (and ``seed`` added per repeat when passed). Keys keep the family's
    order; keys the family does not define stay absent. The only lambda
    reads nothing but its own element."""
    t, p = temperature.cast("double"), top_p.cast("double")
    value = {"temperature": F.coalesce(t, family_params["temperature"]),
             "top_p": F.coalesce(p, family_params["top_p"])}
    entries = [F.struct(F.lit(k).alias("key"), value.get(k, family_params[k]).alias("value"))
               for k in SAMPLING_KEYS]
    if seed is not None:
        entries.append(F.struct(F.lit("seed").alias("key"), seed.cast("double").alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def repeat_questions(questions: DataFrame, num_repeats: int) -> DataFrame:
    """Every question once per repeat (a generator, not a join)."""
    return questions.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(num_repeats - 1))))


def questions_with_prompts(questions: DataFrame) -> DataFrame:
    """A8 + P5: add the formatted question text and the chat message list."""
    q = format_question(F.col("benchmark"), F.col("question"), F.col("choices"))
    return (questions.withColumn("prompt_text", q)
            .withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt_text").alias("content")))))


def first_n_questions(questions: DataFrame, max_samples: int | None, pos_col: str = "pos") -> DataFrame:
    """The first ``max_samples`` questions of each benchmark in order of position (ties by id), whatever the positions are.

    Questions without a ``benchmark`` column are of one benchmark. Spark keeps that many a benchmark in each task before it shuffles, so a large benchmark is no hot key."""
    if max_samples is None:
        return questions
    order = [c for c in (pos_col, "id") if c in questions.columns]
    if "benchmark" not in questions.columns:
        return questions.orderBy(*order).limit(max_samples)
    order = Window.partitionBy("benchmark").orderBy(*order)
    return questions.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= max_samples).drop("_at")


def grade_traces(folded: DataFrame, questions: DataFrame, benchmark, model_family: str,
                 token_count=whitespace_token_count, question_key: str = "question_id") -> DataFrame:
    """J7 + A1 + A7 + A15 + A16: one trace row per (repeat, question).

    The folded generation is joined to its question (equi-join on the
    question id; one without a question is an error), split into reasoning and answer after the family's forced
    prefix, graded on the answer part, and its reasoning tokens counted
    (0 for empty reasoning). For truncated rows, ``reasoning_tokens_added``
    = max(0, full count - count in the round-0 text); the count is a
    pluggable Column function (default: whitespace words; see U1).
    """
    from ..functions import staged
    prefix = eval_family(model_family)[2]
    j = folded.join(questions.withColumn("_known", F.lit(True)), question_key, "left")
    j = j.withColumn("reference", F.when(F.col("_known").isNull(), F.raise_error(F.concat(
        F.lit("no question for generation "), F.col(question_key).cast("string")))).otherwise(F.col("reference"))).drop("_known")
    j = staged.with_split_think_answer(j, prefix, "text", "thinking", "final_answer_text")
    # The round-0 split is only needed for truncated rows (A16); other rows skip it.
    j = j.withColumn("_init_src", F.when(F.col("was_truncated"), F.col("initial_round_text")))
    j = staged.with_split_think_answer(j, prefix, "_init_src", "_init_thinking", "_init_answer")
    b = F.lit(benchmark) if isinstance(benchmark, str) else benchmark
    j = staged.with_grade(j.withColumn("benchmark", b), "benchmark", "final_answer_text", "reference",
                          "is_correct", "extracted_answer")
    rt = F.when(F.col("thinking") == "", F.lit(0)).otherwise(token_count(F.col("thinking")))
    it = F.when(F.col("_init_thinking") == "", F.lit(0)).otherwise(token_count(F.col("_init_thinking")))
    j = j.withColumns({"reasoning_tokens": rt.cast("long"), "_init_tokens": it})
    extra = [c for c in folded.columns if c not in ("repeat", question_key, "text", "initial_round_text",
                                                    "prompt_tokens", "output_tokens", "initial_round_output_tokens",
                                                    "continuation_output_tokens", "was_truncated", "still_truncated",
                                                    "num_rounds", "last_round", "benchmark")]
    return j.select(
        *extra, "repeat", "benchmark", question_key, "reference", F.col("text").alias("raw_response"),
        "thinking", "final_answer_text", "extracted_answer", "is_correct",
        "was_truncated", "still_truncated", "prompt_tokens", "output_tokens", "continuation_output_tokens",
        "reasoning_tokens",
        F.when(F.col("was_truncated"), F.greatest(F.lit(0), F.col("reasoning_tokens") - F.col("_init_tokens")))
        .cast("long").alias("reasoning_tokens_added"))


def seed_for_repeat(repeat: Column, seed_base: int = DEFAULT_SEED_BASE) -> Column:
    return F.lit(seed_base) + repeat
