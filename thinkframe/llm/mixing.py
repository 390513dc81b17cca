"""Operator 2: mixing sources to target weights by subset-sum budget fitting.

A source's budget is met by whole rounds over all its documents and a
remainder. Documents are counted by exact length; the remainder is drawn
from every length in proportion, filled up by long documents, and the last
words are fitted by a bounded-knapsack dynamic programme over the counts left.
Which documents of a length are taken is settled by a seeded order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .host_rules import SPACES
from .ranks import spread_rank
from .staging import nfc, ship_package, staged

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words that the dynamic programme fits at the end.
FIT_WORDS = 8192


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, copies: int = 1) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` from below as can be found.

    Each is taken once at most while that serves; only where it falls short, up to ``copies`` times.
    """
    order = np.argsort(-lengths)
    size, have = lengths[order].astype(object), counts[order].astype(object)
    total = int((size * have).sum())
    bulk = max(0, budget - FIT_WORDS)  # the rest is left to the programme
    take = np.array([min(int(h), int(h) * bulk // max(total, 1)) for h in have], dtype=object)
    for limit in (have, have * copies):
        left = budget - int((size * take).sum())
        for i in range(len(size)):  # long documents first, leaving room for the programme
            more = min(limit[i] - take[i], max(0, left - FIT_WORDS) // size[i])
            take[i] += more
            left -= more * size[i]
        take = _fit_rest(size, limit, take, left)
        if budget == int((size * take).sum()):
            break
    out = np.empty(len(take), dtype=np.int64)
    out[order] = take
    return out


def _fit_rest(size: np.ndarray, have: np.ndarray, take: np.ndarray, left: int) -> np.ndarray:
    """Bounded knapsack on the remaining words: bit s of ``reach`` says that s words can be made; counts go in powers of two."""
    left = min(left, int((size * (have - take)).sum()))
    mask, reach, trail = (1 << (left + 1)) - 1, 1, []
    for i in range(len(size) - 1, -1, -1):  # short lengths first
        spare, part = min(have[i] - take[i], left // size[i]), 1
        while spare > 0 and not reach >> left & 1:
            part = min(part, spare)
            grown = reach | reach << (part * size[i]) & mask
            if grown != reach:
                trail.append((i, part, reach))
                reach = grown
            spare -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(trail):
        if not before >> at & 1:
            at -= part * size[i]
            take[i] += part
    return take


def _fit_source(key, table):
    lengths, counts = table.column("size").to_numpy(), table.column("n").to_numpy()
    take = fit_counts(lengths, counts, int(table.column("budget")[0].as_py()), int(table.column("copies")[0].as_py()))
    return pa.table({"src": table.column("src"), "size": lengths, "take": take})


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """(src, source_size, target): ``sizes`` has src (a struct that orders sources) and source_size, one row a source.

    Weights go round the sources in order. Targets share the sum of all sizes by
    weight; one above ``cap`` times its source stops there and the excess is
    shared again, until none is above.
    """
    # One row a source, so the order over all of them is small beside the documents.
    place = F.row_number().over(Window.orderBy("src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = staged(sizes.withColumn("weight", weight), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(share) >= cap * F.col("source_size") if share else F.lit(False)
        r = rows.agg(F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)).alias("fixed"),
                     F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
                     F.count(F.when(full, 1)).alias("n")).first()
        if r.n == capped or not r.weight:
            break
        capped, share = r.n, (total - r.fixed) / r.weight
    return rows.select("src", "source_size", F.least(F.col("weight") * F.lit(float(share)), F.col("source_size") * float(cap)).cast("double").alias("target"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, see ``mixed_rows``."""
    return mixed_rows(docs, id_col, text_col, source_col, weights, seed).drop("draw")


def text_draw(text: Column, seed: int = 17) -> Column:
    """The hash that settles the order of texts of one length."""
    return F.xxhash64(text, F.lit(seed))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, draw (``text_draw``, which tells rows of one id apart), size, source_size, target, taken.

    ``size`` counts the words of the whole text (null: 0). ``taken`` is the words that
    the mix takes of the row: whole rounds of its source times its size, once more
    if it is chosen for the remainder (more only if the source's other documents cannot fill it), so at most three times its size. A null source is
    a source of its own, last in order. Repeated rows are separate documents; an
    empty table gives an empty result; other columns are ignored. The same
    rows and seed give the same mix.
    """
    ship_package(docs.sparkSession)
    source = nfc(source_col)
    src = F.struct(source.isNull().alias("last"), F.coalesce(source, F.lit("")).alias("name"))
    n_words = F.size(F.filter(F.split(F.coalesce(nfc(text_col), F.lit("")), SPACES), lambda w: w != ""))
    sized = staged(docs.select(nfc(id_col).alias("doc_id"), src.alias("src"), n_words.cast("long").alias("size"),
                               text_draw(nfc(text_col), seed).alias("draw")), "sized")
    lengths = staged(sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    targets = source_targets(lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = targets.withColumn("rounds", F.least(rounds, F.lit(MAX_REPEATS))).withColumn(
        "budget", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
    fitted = (lengths.where("size > 0").join(planned.where("budget > 0").select("src", "budget", (MAX_REPEATS - F.col("rounds")).alias("copies")), "src")
              .groupBy("src").applyInArrow(_fit_source, "src struct<last:boolean,name:string>, size long, take long"))
    plan = lengths.join(planned, "src").join(fitted, ["src", "size"], "left").select(
        "src", "size", "n", "source_size", "target", "rounds", F.coalesce("take", F.lit(0)).alias("take"))
    plan = staged(plan, "plan")
    # Only lengths whose documents are not all taken alike need a draw.
    once, more = F.floor(F.col("take") / F.col("n")), F.col("take") % F.col("n")
    part = plan.where(more > 0).select("src", "size", once.alias("once"), more.alias("more"))
    drawn = spread_rank(sized.join(part, ["src", "size"]), ["src", "size"], F.xxhash64("doc_id", "draw"),
                        [F.xxhash64("draw", "doc_id"), F.col("doc_id")], "rank")
    chosen = drawn.withColumn("extra", F.col("once") + (F.col("rank") < F.col("more")).cast("int"))
    whole = sized.join(plan.where(more == 0).select("src", "size", once.alias("extra")), ["src", "size"])
    both = chosen.select("doc_id", "draw", "src", "size", "extra").unionByName(whole.select("doc_id", "draw", "src", "size", "extra"))
    return (both.join(planned.select("src", "source_size", "target", "rounds"), "src")
            .select("doc_id", "draw", "size", "source_size", "target", (F.col("size") * (F.col("rounds") + F.col("extra"))).cast("long").alias("taken")))
