"""Derived views over the driver tables (F1-F4, F6-F9 in FIXTURES.md).

They turn the generic tables into the shapes the operators consume: raw
examples, model responses, generation rounds, graded traces, run logs,
memory samples, multiple-choice items and token arrays. Every view reads
the whole source table; the SQL twins live in ``thinkframe.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_THINK_CLOSE, DEFAULT_THINK_OPEN, IGNORE_INDEX
from ..functions.text import py_strip
from .tables import read_table

MASK_TOKEN_CHARS = 3


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one raw example per assistant turn that follows a user turn.

    prompt = the user turn; thinking = TAB+NBSP + every line but the last;
    answer = the last line + newline (edge whitespace exercises stripping).
    The self-join is on the unique (conv_id, turn) pair, so no key is hot.
    """
    c = read_table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    u = c.where(F.col("role") == "user").select(
        F.col("conv_id").alias("u_conv"), (F.col("turn") + 1).alias("u_next"), F.col("text").alias("prompt"))
    j = a.join(u, (a.conv_id == u.u_conv) & (a.turn == u.u_next))
    last = F.split_part(F.col("text"), F.lit("\n"), F.lit(-1))
    return j.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("ex_id"),
        F.col("prompt"),
        F.concat(F.lit("\t\u00a0"), F.col("text").substr(F.lit(1), F.length("text") - F.length(last))).alias("thinking"),
        F.concat(last, F.lit("\n")).alias("answer"),
    )


def with_injected_nulls(examples: DataFrame) -> DataFrame:
    """F1 for P1: answer NULL where ex_id % 1000 < 100, thinking NULL where ex_id % 1500 < 100."""
    return examples.select(
        "ex_id", "prompt",
        F.when(F.col("ex_id") % 1500 >= 100, F.col("thinking")).alias("thinking"),
        F.when(F.col("ex_id") % 1000 >= 100, F.col("answer")).alias("answer"))


_F2_RESPONSE = """
'<think>' || chr(10) || text ||
case when doc_id % 9 = 7 then '' else chr(10) || '</think>' || chr(10) || chr(10) end ||
'The answer is ' ||
case doc_id % 9
  when 0 then chr(92) || 'boxed{' || cast(doc_id % 7 as string) || '}'
  when 1 then chr(92) || 'boxed{' || chr(92) || 'text{' || cast(doc_id % 7 as string) || '}}'
  when 2 then chr(92) || 'boxed{ ' || cast(doc_id % 7 as string) || '.0 }'
  when 3 then chr(92) || 'boxed{{' || cast(doc_id % 7 as string) || '}}'
  when 4 then chr(92) || 'boxed{1} or ' || chr(92) || 'boxed{$' || cast(doc_id % 7 as string) || '$}'
  when 5 then chr(92) || 'boxed{' || cast(doc_id % 7 as string)
  when 6 then 'option ' || substr('ABCD', cast(doc_id % 5 % 4 as int) + 1, 1)
  when 7 then chr(92) || 'boxed{' || cast(doc_id % 7 as string) || '}'
  else chr(92) || 'boxed{(' || substr('ABCD', cast(doc_id % 5 % 4 as int) + 1, 1) || ')}'
end"""


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one response per document, in nine box shapes by doc_id % 9."""
    d = read_table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id as question_id", "lang",
        "cast((doc_id * doc_id) % 7 as string) as reference",
        "substr('ABCD', cast(doc_id % 3 as int) + 1, 1) as ref_letter",
        f"{_F2_RESPONSE} as response")


def generation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rounds (question_id, repeat, round, text, prompt_tokens,
    output_tokens, finish_reason) from all assistant turns, three repeats;
    all but a conversation's last turn end in 'length'.

    User and assistant turns alternate after an optional system turn, so the
    round is (turn - 1) div 2, read off each row, and a turn has a next round
    if (conv_id, turn + 2) is there: one equi-join on a unique key.
    """
    a = (read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
         .select("conv_id", "turn", "text"))
    later = a.select("conv_id", (F.col("turn") - 2).alias("turn"), F.lit(True).alias("more"))
    c = a.join(later, ["conv_id", "turn"], "left").withColumn("round", F.floor((F.col("turn") - 1) / 2))
    r = c.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    fin = (F.when(F.col("more"), F.lit("length"))
           .when((F.length("text") + F.col("repeat")) % 4 == 0, F.lit("length"))
           .otherwise(F.lit("stop")))
    return r.select(
        F.col("conv_id").alias("question_id"), F.col("repeat").cast("int").alias("repeat"),
        F.col("round").cast("int").alias("round"), "text",
        (F.lit(10) + F.col("conv_id") % 20).cast("long").alias("prompt_tokens"),
        F.length("text").cast("long").alias("output_tokens"),
        fin.alias("finish_reason"))


def round_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for F3: one per conversation (first user turn as the question,
    reference = conv_id % 7 as text)."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return first.select(F.col("conv_id").alias("question_id"), "question",
                        (F.col("conv_id") % 7).cast("string").alias("reference"))


def graded_traces(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """graded trace rows per (run, repeat, question) from documents;
    run3 lacks repeat 2 so it is incomplete. ``documents`` may be a stream of the table."""
    d = read_table(spark, sf_dir, "documents") if documents is None else documents
    r = d.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    r = r.where(~((F.col("doc_id") % 3 == 2) & (F.col("repeat") == 2)))
    lang, doc, rep = F.col("lang"), F.col("doc_id"), F.col("repeat")
    return r.select(
        F.when(lang == "en", "s1k11_all_qwen3").when(lang == "de", "s1k11_correct_only_qwen3")
         .when(lang == "fr", "s1k11_all_dsr1_llama8b").otherwise("base_qwen3").alias("dataset_name"),
        F.when(~lang.isin("en", "de", "fr"), "base").when(doc % 2 == 0, "cotgen")
         .otherwise("cotcond").alias("mode"),
        F.when(doc % 4 == 0, "aime24").when(doc % 4 == 1, "aime25").when(doc % 4 == 2, "math500")
         .otherwise("gpqa_diamond").alias("benchmark"),
        F.concat(F.lit("run"), (F.lit(1) + doc % 3).cast("string")).alias("run_id"),
        rep.cast("int").alias("repeat"),
        doc.alias("question_id"),
        ((doc * 7 + rep * 3) % 4 != 0).alias("is_correct"),
        ((doc + rep) % 5 == 0).alias("was_truncated"),
        ((doc + rep) % 15 == 0).alias("still_truncated"),
        (F.lit(10) + doc % 20).cast("long").alias("prompt_tokens"),
        F.col("n_chars").alias("output_tokens"),
        F.floor(F.col("n_chars") / 5).cast("long").alias("reasoning_tokens"),
        F.floor(F.col("n_chars") / 9).cast("long").alias("initial_reasoning_tokens"),
        (F.lit(10) + rep).cast("double").alias("elapsed_seconds"),
    )


def train_run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """training run-log rows from events, 12 groups; duplicate
    (dataset_name, mode) keys by attempt; runtime 0 on attempt 3;
    attempt 2 failed (no train results); one dataset has no eval rows."""
    e = read_table(spark, sf_dir, "events")
    u = F.col("user_id")
    g = e.groupBy((u % 3).alias("k3"), (u % 2).alias("k2"), (u % 4).alias("k4")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("num_input_tokens_seen"),
        F.countDistinct("event_type").alias("n_types"),
        F.sum("event_id").cast("double").alias("total_flos"),
        F.min("value").alias("train_loss"),
        F.max("value").alias("peak_mem"))
    name = (F.when(F.col("k3") == 0, "s1k11_all_qwen3").when(F.col("k3") == 1, "s1k11_correct_only_qwen3")
            .otherwise("s1k11_all_gone"))
    mode = F.when(F.col("k2") == 0, "cotgen").otherwise("cotcond")
    return g.select(
        name.alias("dataset_name"), mode.alias("mode"), F.col("k4").alias("attempt"),
        F.col("start_ts").cast("timestamp").alias("start_ts"), F.col("end_ts").cast("timestamp").alias("end_ts"),
        "num_input_tokens_seen",
        F.when(F.col("k4") == 3, F.lit(0)).otherwise(F.col("n_types")).cast("double").alias("train_runtime"),
        "total_flos", "train_loss", "peak_mem",
        F.when(F.col("k4") == 2, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
        F.when(F.col("k4") < 2, F.lit("0")).otherwise(F.lit("0,1")).alias("gpu_ids"))


def memory_samples(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """one memory value per event: (run_id, gpu, sample_ts, mem). ``events`` may be a stream of the table."""
    e = read_table(spark, sf_dir, "events") if events is None else events
    return e.select(
        F.concat(F.lit("run"), (F.col("user_id") % 10).cast("string")).alias("run_id"),
        F.col("event_type").alias("gpu"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("sample_ts"),
        F.col("value").alias("mem"))


def multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: raw multiple-choice rows; option o0 is the correct one."""
    d = read_table(spark, sf_dir, "documents")
    sid = F.col("doc_id").cast("string")
    return d.select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("rec"), sid).alias("id"),
        F.col("text").alias("question"),
        F.concat(F.lit("right-"), sid).alias("o0"), F.concat(F.lit("wrong1-"), sid).alias("o1"),
        F.concat(F.lit("wrong2-"), sid).alias("o2"), F.concat(F.lit("wrong3-"), sid).alias("o3"))


def mask_variant_response(thinking: Column, answer: Column, variant: Column,
                          think_open: str = DEFAULT_THINK_OPEN, think_close: str = DEFAULT_THINK_CLOSE) -> Column:
    t, a, o, c = py_strip(thinking), py_strip(answer), F.lit(think_open), F.lit(think_close)
    return (F.when(variant == 0, F.concat(o, t, c, a))
            .when(variant == 1, F.concat(o, t, a))
            .when(variant == 2, F.concat(c, t, o, a))
            .when(variant == 3, F.concat(o, t, c, a, c, a))
            .otherwise(F.concat(o, c, a)))


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token arrays from F1. The response (variant by floor(ex_id/100) % 5:
    normal, no close tag, close before open, second close in the answer,
    empty thinking) and the whole prompt are cut into 3-character tokens;
    the prompt's are labelled -100; other labels are the token position."""
    ex = raw_examples(spark, sf_dir)
    v = (F.floor(F.col("ex_id") / 100) % 5).cast("int")
    resp = mask_variant_response(F.col("thinking"), F.col("answer"), v)
    k = MASK_TOKEN_CHARS
    df = ex.select("ex_id", v.alias("variant"), "prompt", resp.alias("response"))
    def pieces(c):
        return F.regexp_extract_all(F.col(c), F.lit(f"(?s).{{1,{k}}}"), 0)

    toks = df.select("ex_id", "variant", "response", F.size(pieces("prompt")).alias("np"),
                     F.concat(pieces("prompt"), pieces("response")).alias("token_texts"))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.col("np")),
                      F.sequence(F.col("np"), F.size("token_texts") - 1))
    return toks.withColumn("labels", labels).drop("np")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as F9, but prompt and response are cut into tokens of three bytes of their UTF-8 form, so tokens split characters."""
    ex = raw_examples(spark, sf_dir)
    v = (F.floor(F.col("ex_id") / 100) % 5).cast("int")
    df = ex.select("ex_id", v.alias("variant"), "prompt", mask_variant_response(F.col("thinking"), F.col("answer"), v).alias("response"))

    def pieces(c):
        cut = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(f"(.{{1,{2 * MASK_TOKEN_CHARS}}})"), 1)
        return F.transform(cut, F.unhex)

    toks = df.select("ex_id", "variant", F.size(pieces("prompt")).alias("np"), F.concat(pieces("prompt"), pieces("response")).alias("token_bytes"))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.col("np")), F.sequence(F.col("np"), F.size("token_bytes") - 1))
    return toks.withColumn("labels", labels).drop("np")
