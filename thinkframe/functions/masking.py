"""Reasoning-content loss mask over token arrays.

Inputs are per-example arrays: ``token_texts`` (the decoded text of each
token, so that decoding a prefix equals concatenating its texts, or the bytes of each
token, where one may hold a part of a character) and ``labels`` (``-100`` for ignored positions). The mask is computed in one
pass per array with ``transform``/``aggregate``; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IGNORE_INDEX
from ._util import col
from .text import find_last

_MORE = "(?:[89AB].)"
#: What a UTF-8 decoder makes one character of, in hexadecimal: a whole sequence, as much of one as is right (a replacement
#: character), or a byte that begins none (one too). The alternatives are the states of the decoder after a first byte.
UTF8_UNIT = "|".join((
    "[0-7].", f"(?:C[2-9A-F]|D.){_MORE}?", f"E0(?:[AB].{_MORE}?)?", f"(?:E[1-9A-CEF]){_MORE}{{0,2}}", f"ED(?:[89].{_MORE}?)?",
    f"F0(?:[9AB].{_MORE}{{0,2}})?", f"F[1-3]{_MORE}{{0,3}}", f"F4(?:8.{_MORE}{{0,2}})?", ".."))


def bytes_hex(token_bytes) -> Column:
    """The bytes of all tokens, in hexadecimal."""
    return F.array_join(F.transform(col(token_bytes), lambda t: F.hex(t)), "")


def decoded_units(hex_text) -> Column:
    """The bytes of each character of the decoded text, in hexadecimal; bytes that are no UTF-8 make replacement characters."""
    return F.regexp_extract_all(col(hex_text), F.lit(f"({UTF8_UNIT})"), 1)


def decoded_text(hex_text) -> Column:
    """The decoded text, with as many characters as ``decoded_units`` has entries."""
    return F.make_valid_utf8(F.unhex(col(hex_text)).cast("string"))


def reached_byte(units, target: Column) -> Column:
    """How many bytes a prefix needs so that it decodes to ``target`` characters: a character counts, as a replacement, from its first byte on."""
    return F.when(target > 0, (F.length(F.array_join(F.slice(col(units), 1, F.greatest(target - 1, F.lit(0))), "")) / 2 + 1).cast("int")).otherwise(target)


def response_start(labels) -> Column:
    """1-based position of the first label that is not ignored; 0 when none (A10)."""
    return F.array_position(F.transform(col(labels), lambda x: x != F.lit(IGNORE_INDEX)), True)


def char_to_token_index(token_texts, *targets: Column) -> list[Column]:
    """For each character target: the smallest i >= 1 such that the first i
    tokens cover at least ``target`` characters, else the token count (A12).

    Equal to ``least(n, 1 + #{i : cumlen(i) < target})`` because cumulative
    lengths never decrease; all targets are counted in one ``aggregate`` pass.
    """
    toks = col(token_texts)
    n = F.size(toks)
    # Targets ride in the accumulator so the lambda never re-evaluates them.
    init = F.struct(F.lit(0).alias("cum"),
                    *[F.lit(0).alias(f"c{j}") for j in range(len(targets))],
                    *[tg.alias(f"t{j}") for j, tg in enumerate(targets)])

    def step(acc, t):
        cum = acc["cum"] + F.length(t)
        return F.struct(cum.alias("cum"),
                        *[(acc[f"c{j}"] + F.when(cum < acc[f"t{j}"], 1).otherwise(0)).alias(f"c{j}")
                          for j in range(len(targets))],
                        *[acc[f"t{j}"].alias(f"t{j}") for j in range(len(targets))])

    acc = F.aggregate(toks, init, step)
    return [F.least(n, acc[f"c{j}"] + 1) for j in range(len(targets))]


def think_mask(token_texts, labels, think_open: str, think_close: str) -> Column:
    """``struct(labels, mask_status, mask_start, mask_end)``.

    Within the response span (from the first supervised label), the first
    ``think_open`` and the last ``think_close`` are located in the decoded
    text; labels of tokens in ``[start + cs, start + ce)`` become -100, where
    cs/ce map the content start and end characters to token indices. Any
    missing tag, a close before the open, or an empty token range leaves the
    labels unchanged (fail open); ``mask_status`` says which case applied.
    """
    lab = col(labels)
    toks = col(token_texts)
    rs = response_start(lab)
    span = F.slice(toks, F.greatest(rs, F.lit(1)), F.greatest(F.size(toks) - rs + 1, F.lit(0)))
    decoded = F.array_join(span, "")
    o = F.instr(decoded, think_open) - 1
    c = find_last(decoded, think_close)
    cs, ce = char_to_token_index(span, o + F.lit(len(think_open)), c)
    status = (F.when(rs == 0, F.lit("no_response"))
              .when(o < 0, F.lit("no_open_tag"))
              .when(c < 0, F.lit("no_close_tag"))
              .when(c <= o, F.lit("close_before_open"))
              .when(ce <= cs, F.lit("empty_span"))
              .otherwise(F.lit("masked")))
    lo = (rs - 1 + cs).cast("int")
    hi = (rs - 1 + ce).cast("int")
    # Slices instead of a per-element lambda: the bounds are evaluated once per row.
    masked = F.concat(F.slice(lab, 1, lo), F.array_repeat(F.lit(IGNORE_INDEX), hi - lo),
                      F.slice(lab, hi + 1, F.size(lab) - hi))
    is_masked = status == "masked"
    return F.struct(F.when(is_masked, masked).otherwise(lab).alias("labels"),
                    status.alias("mask_status"),
                    F.when(is_masked, lo).alias("mask_start"),
                    F.when(is_masked, hi).alias("mask_end"))
