"""Answer extraction and grading."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (BOXED_MARK, CHOICE_LETTERS, EDGE_STRIP_CHARS, LATEX_REMOVALS, NUMERIC_TOLERANCE,
                         TEXT_WRAPPER_PATTERN, TRAILING_STRIP_CHARS)
from ._util import col, lit
from .text import py_strip

# Python float() literal syntax (ASCII digits, optional underscores between
# digits, optional fraction and exponent). Spark's cast is more lenient
# (accepts "1d", "0x1p3") and rejects "1_000", so the cast is guarded by this
# pattern and underscores are removed first. inf/nan never compare equal
# under |a-b| < 1e-6, so they are simply not matched.
PY_FLOAT_PATTERN = (r"^[+-]?((\d(_?\d)*)?\.\d(_?\d)*|\d(_?\d)*\.?)"
                    r"([eE][+-]?\d(_?\d)*)?$")

# Every Unicode decimal digit (category Nd) and its ASCII value, built by rule:
# Python's float() accepts these digits, so they are mapped to ASCII before
# the syntax check and the cast.
_ND = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]
ND_DIGITS = "".join(_ND)
ND_ASCII = "".join(str(unicodedata.digit(ch)) for ch in _ND)

# Word-character complement used instead of \b (Java's and RE2's \b are not
# Unicode-aware the way Python's str patterns are).
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"


def _count_char(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def last_boxed(text) -> Column:
    """Contents of the last ``\\boxed{...}`` with balanced braces, else NULL.

    Only the last occurrence is tried. The text after it is split on ``}``;
    the content ends at the first ``}`` where 1 + (opens so far) - (closes so
    far) reaches 0. One pass with ``aggregate``.
    """
    t = col(text)
    tail = F.substring_index(t, BOXED_MARK, -1)
    segs = F.split(tail, r"\}", -1)
    # The segment count rides in the accumulator so the lambda never
    # re-evaluates the split.
    init = F.struct(F.lit(0).alias("i"), F.lit(1).alias("d"), F.lit(0).alias("k"), F.size(segs).alias("n"))

    def step(acc, seg):
        i1 = acc["i"] + 1
        d1 = acc["d"] + _count_char(seg, "{") - 1
        found = (acc["k"] == 0) & (i1 < acc["n"]) & (d1 == 0)
        return F.struct(i1.alias("i"),
                        F.when(acc["k"] > 0, acc["d"]).otherwise(d1).alias("d"),
                        F.when(found, i1).otherwise(acc["k"]).alias("k"),
                        acc["n"].alias("n"))

    k = F.aggregate(segs, init, step)["k"]
    return F.when((F.instr(t, BOXED_MARK) > 0) & (k > 0),
                  F.array_join(F.slice(segs, 1, k), "}"))


def normalize_math_answer(s) -> Column:
    """Light LaTeX normalisation, applied in this order: strip; drop \\left,
    \\right; drop \\!, \\,, \\;; drop \\text{}; unwrap \\text{x}; drop spaces;
    strip trailing dots; strip $ at both ends; strip one outer {} pair."""
    x = py_strip(s)
    for token in LATEX_REMOVALS:
        x = F.replace(x, F.lit(token), F.lit(""))
    x = F.regexp_replace(x, TEXT_WRAPPER_PATTERN, "$1")
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.rtrim(x, F.lit(TRAILING_STRIP_CHARS))
    x = F.btrim(x, F.lit(EDGE_STRIP_CHARS))
    n = F.length(x)
    return F.when(x.startswith("{") & x.endswith("}"),
                  F.when(n >= 2, x.substr(F.lit(2), n - F.lit(2))).otherwise(F.lit(""))).otherwise(x)


def python_float(s) -> Column:
    """float(s) where Python accepts it, else NULL (any Unicode decimal digit
    counts as its ASCII value, as in Python)."""
    t = F.translate(py_strip(s), ND_DIGITS, ND_ASCII)
    return F.when(t.rlike(PY_FLOAT_PATTERN),
                  F.regexp_replace(t, "_", "").try_cast("double"))


def numeric_equal(a, b) -> Column:
    """Both parse as floats and differ by less than 1e-6; never NULL."""
    fa, fb = python_float(a), python_float(b)
    return F.coalesce(F.abs(fa - fb) < F.lit(NUMERIC_TOLERANCE), F.lit(False))


def grade_math(answer_text, reference) -> Column:
    """``struct(is_correct, extracted)``; ``extracted`` is the raw boxed text."""
    ex = last_boxed(answer_text)
    npred = normalize_math_answer(ex)
    nref = normalize_math_answer(col(reference))
    ok = F.when(ex.isNull(), F.lit(False)).otherwise((npred == nref) | numeric_equal(npred, nref))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("is_correct"), ex.alias("extracted"))


def _letters(s: Column) -> Column:
    return F.filter(F.split(F.upper(s), NON_WORD_RUN, -1), lambda w: w.isin(*CHOICE_LETTERS))


def grade_letter(answer_text, reference) -> Column:
    """Multiple-choice grade: first standalone A-D inside the last box, else
    the last standalone A-D in the upper-cased text, else no answer."""
    t = col(answer_text)
    boxed_letter = F.get(_letters(last_boxed(t)), 0)
    text_letters = _letters(t)
    last_letter = F.get(text_letters, F.size(text_letters) - 1)
    letter = F.coalesce(boxed_letter, last_letter)
    ok = F.coalesce(letter == col(reference), F.lit(False))
    return F.struct(ok.alias("is_correct"), letter.alias("extracted"))


def grade(benchmark, answer_text, reference) -> Column:
    """Dispatch: letter grading for gpqa_diamond, boxed-math grading otherwise."""
    b = lit(benchmark)
    return F.when(b == "gpqa_diamond", grade_letter(answer_text, reference)) \
            .otherwise(grade_math(answer_text, reference))
