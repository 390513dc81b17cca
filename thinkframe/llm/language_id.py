"""Operator 4: language identification by prediction by partial matching.

Each language has a tree of byte contexts up to ``ORDER`` bytes, counted from a
bounded sample of labelled texts and then frozen. A byte costs its code length in the longest known
context; where the context has not seen it, the escape's code length is paid
and the next shorter context is asked, down to all bytes alike. A text is of the language
that codes it shortest. Code lengths are whole numbers of 1/4096 bit, so sums are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import nfc, ship_package
from .words import KeyIndex, text_slices

ORDER = 4
#: Bytes of labelled text a language learns from: whole texts in hash order up to this many.
TRAIN_BYTES = 2_000_000
UNDETERMINED = "und"
_UNIT = 4096


def grams(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """For every byte the number made of it and the ``length`` - 1 bytes before it; before a text there are line breaks."""
    out = np.full(len(data), 1, dtype=np.int64)
    starts, ends = offsets[:-1], offsets[1:]
    for back in range(length - 1, -1, -1):
        byte = np.empty(len(data), dtype=np.int64)
        byte[back:] = data[:len(data) - back]
        for k in range(back):
            at = starts + k
            byte[at[at < ends]] = 10
        out = out << 8 | byte
    return out


class ContextTrees:
    """Frozen code lengths of all languages, from counts (language, length of the gram, gram, count)."""

    def __init__(self, languages: list[str], counts: dict[int, list[tuple[np.ndarray, np.ndarray]]]):
        self.languages = languages
        n = len(languages)
        self.cost: list[np.ndarray] = [np.full((1, n), 8.0)]
        self.escape: list[np.ndarray] = []
        self.index: list[KeyIndex] = [KeyIndex(np.array([1], dtype=np.int64))]
        self.contexts: list[KeyIndex] = []
        keys_before = np.array([1], dtype=np.int64)  # the empty gram
        for length in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([k for k, _ in counts[length]]))
            count = np.zeros((len(keys), n))
            for j, (k, c) in enumerate(counts[length]):
                count[np.searchsorted(keys, k), j] = c
            # A context need not be a gram of its own: the line breaks before a text are none.
            contexts, parent = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, parent, count)
            np.add.at(kinds, parent, count > 0)
            seen = total > 0
            escape = np.where(seen, np.log2(np.where(seen, (total + kinds) / np.where(seen, kinds, 1), 1)), 0.0)
            suffix = keys & ((1 << 8 * (length - 1)) - 1) | 1 << 8 * (length - 1)
            shorter = self.cost[-1][np.searchsorted(keys_before, suffix)] if length > 1 else np.full((len(keys), n), 8.0)
            have = count > 0
            own = np.log2(np.where(have, (total + kinds)[parent] / np.where(have, count, 1), 1))
            self.escape.append(escape)
            self.cost.append(np.where(have, own, escape[parent] + shorter))
            self.index.append(KeyIndex(keys))
            self.contexts.append(KeyIndex(contexts))
            keys_before = keys
        self.cost = [np.rint(c * _UNIT).astype(np.int32) for c in self.cost]
        self.escape = [np.rint(e * _UNIT).astype(np.int32) for e in self.escape]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits (in 1/4096) that each language needs for each text."""
        top = ORDER + 1
        gram = grams(data, offsets, top)
        at = self.index[top].find(gram)
        bits = self.cost[top][at]
        todo = np.flatnonzero(at < 0)
        bits[todo] = 0
        for length in range(top, 0, -1):
            if not len(todo):
                break
            g = gram[todo] & ((1 << 8 * length) - 1) | 1 << 8 * length
            context = self.contexts[length - 1].find(g >> 8)
            known = context >= 0
            bits[todo[known]] += self.escape[length - 1][context[known]]
            if length == 1:
                bits[todo] += 8 * _UNIT
                break
            shorter = g & ((1 << 8 * (length - 1)) - 1) | 1 << 8 * (length - 1)
            at = self.index[length - 1].find(shorter)
            hit = at >= 0
            bits[todo[hit]] += self.cost[length - 1][at[hit]]
            todo = todo[~hit]
        sums = np.zeros((len(offsets) - 1, bits.shape[1]), dtype=np.int64)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            sums[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.int64)
        return sums


def _count(key, table):
    """Grams of one language's sample."""
    out = []
    for length in range(1, ORDER + 2):
        for _, data, offsets in text_slices(table.column("text")):
            k, c = np.unique(grams(data, offsets, length), return_counts=True)
            out.append(pa.table({"lang": pa.array([key[0].as_py()] * len(k), pa.string()), "length": pa.array([length] * len(k), pa.int32()), "gram": k, "n": c}))
    return pa.concat_tables(out).group_by(["lang", "length", "gram"]).aggregate([("n", "sum")]).rename_columns(["lang", "length", "gram", "n"])


def learn_languages(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> ContextTrees | None:
    """Context trees from rows (text, lang); null or empty texts and null languages teach nothing. None if nothing is left.

    A language learns from whole distinct texts in the order of their hash until
    ``train_bytes`` are reached, so the model's size does not depend on the
    table's, nor on how often a text is copied. The trees must fit the workers: bounded by languages * bytes.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.where("lang is not null and text is not null and text <> ''").select(
        "lang", "text", F.octet_length("text").alias("size"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("draw"))
    share = rows.groupBy("lang", "draw").agg(F.max("size").alias("size")).groupBy("lang").agg(
        (F.lit(2.0**64 * train_bytes) / F.sum("size")).alias("share"), F.min("draw").alias("least"))
    # Twice the bytes wanted, by hash, and at least one text; the running sum then orders only those, one of each. A row a language.
    drawn = rows.join(F.broadcast(share), "lang").where(F.col("draw") <= F.greatest("share", "least")).dropDuplicates(["lang", "draw"])
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1))
    sample = drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < train_bytes)
    table = sample.select("lang", "text").groupBy("lang").applyInArrow(_count, "lang string, length int, gram long, n long").toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if not languages:
        return None
    lang = np.searchsorted(np.array(languages), np.array(table.column("lang").to_pylist()))
    length, gram, n = (table.column(c).to_numpy() for c in ("length", "gram", "n"))
    counts = {}
    for k in range(1, ORDER + 2):
        counts[k] = [(gram[m], n[m]) for m in ((length == k) & (lang == j) for j in range(len(languages)))]
    return ContextTrees(languages, counts)


def _predict(model):
    """Adds lang_pred and score to rows that hold a text and whether it has a letter."""
    def run(batches):
        trees: ContextTrees = model.value
        languages = np.array([*trees.languages, UNDETERMINED], dtype=object)
        limit = max(65_536, 4_000_000 // (len(trees.languages) + 4))
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column("text"), limit):
                rows = batch.slice(lo, len(offsets) - 1)
                bits = trees.code_lengths(data, offsets) / _UNIT
                best = bits.argmin(axis=1)
                gap = np.minimum(bits - bits.min(axis=1)[:, None], 1000)
                score = 1 / np.exp2(-gap).sum(axis=1)
                silent = ~rows.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                best[silent], score[silent] = len(trees.languages), 0.0
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(languages[best], pa.string()), pa.array(score)],
                                                 [*rows.schema.names, "lang_pred", "score"])
    return run


def with_language(docs: DataFrame, trees: ContextTrees | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with lang_pred and score of its text."""
    text = F.col(text_col)
    rows = docs.select(F.struct(*[nfc(c) for c in docs.columns]).alias("row"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if trees is None:
        return rows.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = rows.schema.names
    flat = rows.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], *names[1:])
    schema = T.StructType([*flat.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = flat.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(trees)), schema)
    return out.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row"), "lang_pred", "score")


def identify_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; learns from rows that are not ``held_out``.

    ``score`` is the share of the best language among all, weighing each by 2 to
    the minus its code length. A null text or one without a letter, and every text if nothing
    could be learned, is ``und`` with score 0. Ties go to the first
    language in order. Repeated rows get equal results; an empty table gives an empty
    result; other columns are ignored. Predictions read the text alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    trees = learn_languages(rows.where(~F.col("held_out")).select("text", "lang"), train_bytes)
    return with_language(rows.drop("lang"), trees).select("row.doc_id", "row.held_out", "lang_pred", "score")
