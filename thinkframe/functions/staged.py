"""DataFrame-level forms of the heavier column functions.

A Column expression that uses an intermediate value several times gets that
value inlined at every use (the mask's decoded span, the box split, ...).
These forms add each intermediate as a column in its own projection, so it
is computed once per row: Catalyst does not collapse a projection whose
non-trivial expression is referenced more than once. Results equal the
Column forms; temporary columns start with ``_`` and are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import EVAL_THINK_CLOSE, EVAL_THINK_OPEN, IGNORE_INDEX
from .grading import BOXED_MARK, _count_char, _letters, normalize_math_answer, numeric_equal
from .masking import bytes_hex, decoded_text, decoded_units, reached_byte, response_start
from .text import find_last, py_strip


def with_split_think_answer(df: DataFrame, prefix, text_col: str, thinking_col: str = "thinking",
                            answer_col: str = "answer", open_tag: str = EVAL_THINK_OPEN,
                            close_tag: str = EVAL_THINK_CLOSE) -> DataFrame:
    """A1 (see ``split_think_answer``) as staged columns."""
    lo, lc = len(open_tag), len(close_tag)
    p = prefix if not isinstance(prefix, str) else F.lit(prefix)
    full0 = F.concat(p, F.col(text_col))
    d = df.withColumns({"_full": full0, "_o": F.instr(full0, open_tag)})   # concat shared by codegen CSE
    d = d.withColumn("_c", F.when(F.col("_o") > 0, F.position(F.lit(close_tag), F.col("_full"), F.col("_o") + lo))
                     .otherwise(F.lit(0)))
    full, o, c = F.col("_full"), F.col("_o"), F.col("_c")
    matched = (o > 0) & (c > 0)
    d = d.withColumns({
        thinking_col: F.when(matched, py_strip(full.substr(o + F.lit(lo), c - o - F.lit(lo)))).otherwise(F.lit("")),
        answer_col: F.when(matched, py_strip(full.substr(c + F.lit(lc), F.lit(2147483647)))).otherwise(py_strip(full))})
    return d.drop("_full", "_o", "_c")


def with_last_boxed(df: DataFrame, text_col: str, out_col: str = "boxed") -> DataFrame:
    """A2 (see ``last_boxed``) as staged columns."""
    t = F.col(text_col)
    d = df.withColumn("_segs", F.when(F.instr(t, BOXED_MARK) > 0,
                                      F.split(F.substring_index(t, BOXED_MARK, -1), r"\}", -1)))
    init = F.struct(F.lit(0).alias("i"), F.lit(1).alias("d"), F.lit(0).alias("k"), F.size("_segs").alias("n"))

    def step(acc, seg):
        i1 = acc["i"] + 1
        d1 = acc["d"] + _count_char(seg, "{") - 1
        found = (acc["k"] == 0) & (i1 < acc["n"]) & (d1 == 0)
        return F.struct(i1.alias("i"), F.when(acc["k"] > 0, acc["d"]).otherwise(d1).alias("d"),
                        F.when(found, i1).otherwise(acc["k"]).alias("k"), acc["n"].alias("n"))

    d = d.withColumn("_k", F.aggregate(F.col("_segs"), init, step)["k"])
    d = d.withColumn(out_col, F.when(F.col("_k") > 0, F.array_join(F.slice("_segs", 1, F.col("_k")), "}")))
    return d.drop("_segs", "_k")


def math_grade_from_box(d: DataFrame, box_col: str, reference_col: str, correct_col: str, extracted_col: str) -> DataFrame:
    """A3-A5 given an already extracted box column (shared by several graders)."""
    d = d.withColumns({"_np": normalize_math_answer(F.col(box_col)),
                       "_nr": normalize_math_answer(F.col(reference_col))})
    ok = F.when(F.col(box_col).isNull(), F.lit(False)).otherwise(
        (F.col("_np") == F.col("_nr")) | numeric_equal(F.col("_np"), F.col("_nr")))
    d = d.withColumns({correct_col: F.coalesce(ok, F.lit(False)), extracted_col: F.col(box_col)})
    return d.drop("_np", "_nr")


def letter_grade_from_box(d: DataFrame, answer_col: str, box_col: str, reference_col: str, correct_col: str,
                          extracted_col: str) -> DataFrame:
    """A6 given an already extracted box column (shared by several graders)."""
    d = d.withColumn("_bl", F.get(_letters(F.col(box_col)), 0))
    # The whole-answer scan runs only for rows whose box holds no letter.
    d = d.withColumn("_tl", F.when(F.col("_bl").isNull(), _letters(F.col(answer_col))))
    letter = F.coalesce(F.col("_bl"), F.get(F.col("_tl"), F.size("_tl") - 1))
    d = d.withColumn(extracted_col, letter)
    d = d.withColumn(correct_col, F.coalesce(F.col(extracted_col) == F.col(reference_col), F.lit(False)))
    return d.drop("_bl", "_tl")


def with_grade_math(df: DataFrame, answer_col: str, reference_col: str, correct_col: str = "is_correct",
                    extracted_col: str = "extracted") -> DataFrame:
    """A5 (see ``grade_math``) as staged columns."""
    d = with_last_boxed(df, answer_col, "_box")
    return math_grade_from_box(d, "_box", reference_col, correct_col, extracted_col).drop("_box")


def with_grade_letter(df: DataFrame, answer_col: str, reference_col: str, correct_col: str = "is_correct",
                      extracted_col: str = "extracted") -> DataFrame:
    """A6 (see ``grade_letter``) as staged columns."""
    d = with_last_boxed(df, answer_col, "_box")
    return letter_grade_from_box(d, answer_col, "_box", reference_col, correct_col, extracted_col).drop("_box")


def with_grade(df: DataFrame, benchmark_col: str, answer_col: str, reference_col: str,
               correct_col: str = "is_correct", extracted_col: str = "extracted") -> DataFrame:
    """Letter grading for gpqa_diamond rows, boxed-math grading otherwise.
    The last box is extracted once; each grader sees NULLs instead of the other one's rows."""
    letter = F.coalesce(F.col(benchmark_col) == "gpqa_diamond", F.lit(False))
    d = with_last_boxed(df, answer_col, "_box").withColumns({
        "_mbox": F.when(~letter, F.col("_box")), "_lbox": F.when(letter, F.col("_box")),
        "_mref": F.when(~letter, F.col(reference_col)), "_ltext": F.when(letter, F.col(answer_col))})
    d = math_grade_from_box(d, "_mbox", "_mref", "_mc", "_me")
    d = letter_grade_from_box(d, "_ltext", "_lbox", reference_col, "_lc", "_le")
    d = d.withColumns({correct_col: F.when(letter, F.col("_lc")).otherwise(F.col("_mc")),
                       extracted_col: F.when(letter, F.col("_le")).otherwise(F.col("_me"))})
    return d.drop("_box", "_mbox", "_lbox", "_mref", "_ltext", "_mc", "_me", "_lc", "_le")


def apply_think_mask(df: DataFrame, think_open: str, think_close: str, token_col: str = "token_texts",
                     label_col: str = "labels", out_col: str = "masked_labels") -> DataFrame:
    """A10-A13 (see ``think_mask``) as staged columns. Adds ``out_col``,
    ``mask_status``, ``mask_start`` and ``mask_end``.

    ``token_col`` holds texts (array<string>) or bytes (array<binary>). The first i byte tokens cover as many characters as
    decoding them gives, a character of which only a part is there counting as a replacement character. So characters are
    looked up in the decoded text, their targets are turned into bytes, and tokens are walked by bytes."""
    toks, lab = F.col(token_col), F.col(label_col)
    as_bytes = df.schema[token_col].dataType.elementType.typeName() == "binary"
    d = df.withColumn("_rs", response_start(lab))
    d = d.withColumn("_span", F.slice(toks, F.greatest(F.col("_rs"), F.lit(1)),
                                      F.greatest(F.size(toks) - F.col("_rs") + 1, F.lit(0))))
    if as_bytes:
        d = d.withColumn("_hex", bytes_hex("_span")).withColumn("_dec", decoded_text("_hex"))
    else:
        d = d.withColumn("_dec", F.array_join("_span", ""))
    d = d.withColumns({"_o": F.instr(F.col("_dec"), think_open) - 1, "_c": find_last(F.col("_dec"), think_close)})
    opened, closed = F.col("_o") + F.lit(len(think_open)), F.col("_c")
    if as_bytes:
        found = (F.col("_o") >= 0) & (F.col("_c") > F.col("_o"))
        d = d.withColumn("_units", F.when(found, decoded_units("_hex")))
        opened, closed = reached_byte("_units", opened), reached_byte("_units", closed)
    init = F.struct(F.lit(0).alias("cum"), F.lit(0).alias("a"), F.lit(0).alias("b"), opened.alias("ta"), closed.alias("tb"))

    def step(acc, t):
        cum = acc["cum"] + (F.octet_length(t) if as_bytes else F.length(t))
        return F.struct(cum.alias("cum"),
                        (acc["a"] + F.when(cum < acc["ta"], 1).otherwise(0)).alias("a"),
                        (acc["b"] + F.when(cum < acc["tb"], 1).otherwise(0)).alias("b"),
                        acc["ta"].alias("ta"), acc["tb"].alias("tb"))

    d = d.withColumn("_acc", F.aggregate(F.col("_span"), init, step))
    n = F.size("_span")
    d = d.withColumns({"_cs": F.least(n, F.col("_acc.a") + 1), "_ce": F.least(n, F.col("_acc.b") + 1)})
    rs, o, c, cs, ce = (F.col(x) for x in ("_rs", "_o", "_c", "_cs", "_ce"))
    status = (F.when(rs == 0, F.lit("no_response")).when(o < 0, F.lit("no_open_tag"))
              .when(c < 0, F.lit("no_close_tag")).when(c <= o, F.lit("close_before_open"))
              .when(ce <= cs, F.lit("empty_span")).otherwise(F.lit("masked")))
    d = d.withColumn("mask_status", status)
    masked = F.col("mask_status") == "masked"
    d = d.withColumns({"mask_start": F.when(masked, (rs - 1 + cs).cast("int")),
                       "mask_end": F.when(masked, (rs - 1 + ce).cast("int"))})
    lo, hi = F.col("mask_start"), F.col("mask_end")
    d = d.withColumn(out_col, F.when(masked, F.concat(
        F.slice(lab, 1, lo), F.array_repeat(F.lit(IGNORE_INDEX), hi - lo),
        F.slice(lab, hi + 1, F.size(lab) - hi))).otherwise(lab))
    return d.drop("_rs", "_span", "_hex", "_dec", "_o", "_c", "_units", "_acc", "_cs", "_ce")
