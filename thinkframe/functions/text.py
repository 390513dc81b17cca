"""Whitespace handling and the reasoning/answer split (A1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EVAL_THINK_CLOSE, EVAL_THINK_OPEN
from ._util import col, lit

# The characters Python's str.strip() removes: every code point for which
# str.isspace() holds (29 characters). Spark's one-argument trim() removes
# only U+0020, so stripping always goes through btrim(s, WS).
WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

# The same set as a regex character class (Java regex and RE2 both accept \x{..}).
WS_REGEX_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WS) + "]"


def py_strip(c) -> Column:
    """str.strip(): remove leading and trailing Unicode whitespace."""
    return F.btrim(col(c), F.lit(WS))


def find_last(s, sub) -> Column:
    """0-based index of the last occurrence of ``sub`` in ``s`` (str.rfind), -1 if absent."""
    s, sub = col(s), lit(sub)
    q = F.instr(F.reverse(s), F.reverse(sub) if isinstance(sub, Column) else sub)
    return F.when(q > 0, F.length(s) - F.length(sub) - q + 1).otherwise(F.lit(-1))


def split_think_answer(prefix, text, open_tag: str = EVAL_THINK_OPEN,
                       close_tag: str = EVAL_THINK_CLOSE) -> Column:
    """Split ``prefix + text`` into ``struct(thinking, answer)``.

    The span is the leftmost ``open_tag`` followed by the first ``close_tag``
    that starts after it (a lazy, dot-matches-newline search). Both parts are
    stripped. Without such a span the thinking is ``""`` and the answer is the
    whole stripped text. Implemented with instr/locate/substring so it stays
    in generated code.
    """
    full = F.concat(lit(prefix), col(text))
    lo, lc = len(open_tag), len(close_tag)
    o = F.instr(full, open_tag)
    c = F.when(o > 0, F.position(F.lit(close_tag), full, o + F.lit(lo))).otherwise(F.lit(0))
    matched = (o > 0) & (c > 0)
    thinking = F.when(matched, py_strip(full.substr(o + F.lit(lo), c - o - F.lit(lo)))).otherwise(F.lit(""))
    answer = F.when(matched, py_strip(full.substr(c + F.lit(lc), F.lit(2147483647)))).otherwise(py_strip(full))
    return F.struct(thinking.alias("thinking"), answer.alias("answer"))


def whitespace_token_count(c) -> Column:
    """Default reasoning-token counter: number of whitespace-separated words
    (str.split() semantics); 0 for empty text. Every whitespace character is
    first mapped to a plain space with ``translate``, so the split is on one
    literal character (no regex character class, several times faster on
    long texts)."""
    spaced = F.translate(col(c), WS, " " * len(WS))
    return F.size(F.array_remove(F.split(spaced, " ", -1), ""))
