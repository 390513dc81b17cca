"""Operator 8: order-preserving packing of token streams into windows by dynamic programming.

Documents follow each other by id. Windows are cut at ends of documents or
sentences, and inside a long stretch without either. The cost of a
cut sequence is its padding plus a penalty for each document that a cut
divides; with f(j) = min over i of f(i) + padding + penalty(j) and windows of
at most ``window`` ids, the best i leaves a monotone queue. A window whose length is a
power of two needs no padding: the few places that lie such a length before j are tried as well.

Documents are planned together by their place: those that begin in the same ``PLAN_BYTES`` of the table's texts in order. That depends
on the rows alone, not on how Spark cut them into partitions.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import nfc, partitions_for, shuffle_width, ship_package, staged
from .tokens import default_vocabulary, encoder

WINDOW = 2048
END_ID = 1
#: What a cut costs, in padded ids: at a sentence's end, and inside a stretch without one.
SENTENCE_CUT, FORCED_CUT = 2, 8
#: A stretch without a sentence's end may be cut every so many ids.
STRETCH = 64
#: What a window costs besides its padding, so that no run of tiny powers of two is preferred to one window.
WINDOW_COST = 8
#: Bytes of text that are planned together (some two million ids).
PLAN_BYTES = 8_000_000


def candidate_cuts(ids: np.ndarray, ends: np.ndarray, is_end: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end (counted in ids, ascending, the stream's end last) and what a cut there costs."""
    places = np.union1d(np.flatnonzero(is_end[ids]) + 1, ends)
    gaps = np.diff(np.concatenate([[0], places]))
    long_ = np.flatnonzero(gaps > stretch)
    extra = [np.arange(places[i] - gaps[i] + stretch, places[i], stretch) for i in long_]
    cost = np.full(len(places), SENTENCE_CUT, dtype=np.int64)
    cost[np.isin(places, ends)] = 0
    if extra:
        added = np.concatenate(extra)
        order = np.argsort(np.concatenate([places, added]), kind="stable")
        cost = np.concatenate([cost, np.full(len(added), FORCED_CUT, dtype=np.int64)])[order]
        places = np.concatenate([places, added])[order]
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW, window_cost: int = WINDOW_COST) -> list[int]:
    """Ends of the windows that minimise padding, cut costs and ``window_cost`` a window; neighbours among ``places`` lie at most ``window`` apart.

    Padding is ``window - length``, or none where the length is a power of two.
    """
    where = np.concatenate([[0], places])
    number = np.full(int(where[-1]) + 1, -1, dtype=np.int64)  # a place's number by its id count
    number[where] = np.arange(len(where))
    exact: dict[int, list[int]] = {}  # places a power of two before a place
    length = 1
    while length < window:
        js = np.flatnonzero(where >= length)
        found = number[where[js] - length]
        for j, i in zip(js[found >= 0].tolist(), found[found >= 0].tolist()):
            exact.setdefault(j, []).append(i)
        length *= 2
    at, price = where.tolist(), [0, *(cost + window_cost).tolist()]
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # by rising best[i] + at[i]
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        f = best[i] + window - here + at[i]
        for e in exact.get(j, ()):
            if best[e] < f:
                f, i = best[e], e
        best[j] = f = f + price[j]
        back[j] = i
        f += here
        while queue and best[queue[-1]] + at[queue[-1]] >= f:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def _pack(path: str, window: int, end_id: int):
    def run(batches):
        enc = encoder(path)
        is_end, end = enc.sentence_ends(), np.array([end_id], dtype="<u4")
        now, names, streams = None, [], []

        def plan():
            ids = np.concatenate(streams)
            ends = np.cumsum([len(s) for s in streams])
            starts = ends - [len(s) for s in streams]
            places, cost = candidate_cuts(ids, ends, is_end)
            cuts = np.array(best_cuts(places, cost, window))
            a = np.union1d(starts, np.concatenate([[0], cuts[:-1]]))
            b = np.append(a[1:], len(ids))
            doc = np.searchsorted(starts, a, side="right") - 1
            seq = np.searchsorted(cuts, a, side="right")
            begin = np.concatenate([[0], cuts[:-1]])[seq]
            data = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc.tolist()], pa.int64()),
                 *(pa.array(c, pa.int64()) for c in (a - starts[doc], b - a, crc, (ends - starts)[doc], (now << 32) + seq, a - begin))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            plans, ids, copies = (batch.column(i).to_pylist() for i in range(3))
            for place, doc_id, times, found in zip(plans, ids, copies, enc.encode(batch.column(3))):
                if place != now and names:
                    yield plan()
                    names, streams = [], []
                now = place
                names += [doc_id] * times
                streams += [np.concatenate([found, end])] * times
        if names:
            yield plan()
    return run


_KEY = ["no_id", "id", "h", "size"]


def plan_places(rows: DataFrame, plan_bytes: int = PLAN_BYTES) -> DataFrame:
    """For each different row (``_KEY``) the plans that it has copies in, and how many: columns of ``_KEY``, plan, copies.

    A row's place is the bytes of all rows before it, in order of id and text hash: a sum over parts of the order and one within its
    part. Copies follow each other and spread over as many plans as they fill. Texts are not moved for this.
    """
    spark = rows.sparkSession
    counted = rows.groupBy(*_KEY).agg(F.count("*").alias("n"))
    order = [F.desc("no_id"), F.asc("id"), F.asc("h"), F.asc("size")]
    parts = staged(counted.repartitionByRange(shuffle_width(spark), *order).withColumn("part", F.spark_partition_id()), "packing-order")
    totals = parts.groupBy("part").agg(F.sum(F.col("n") * F.col("size")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = (parts.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0)))
          .join(firsts, "part").withColumn("at", F.col("first") + F.col("inside")))
    spread = at.withColumn("plan", F.explode(F.expr(f"sequence(at div {plan_bytes}, (at + (n - 1) * size) div {plan_bytes})")))
    upto = "least(n, (greatest({} * {} - at, 0) + size - 1) div size)"
    copies = F.expr(upto.format("(plan + 1)", plan_bytes)) - F.expr(upto.format("plan", plan_bytes))
    return spread.select(*_KEY, "plan", copies.alias("copies")).where("copies > 0")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   vocabulary: str | None = None, end_id: int = END_ID, plan_bytes: int = PLAN_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, the end id included, lies in one piece; pieces of a
    sequence follow each other from offset 0 and hold at most ``window`` ids. Documents
    are planned some eight million bytes at a time in order of id (null first) and text hash, so only the last
    window of a plan may be short; the result does not depend on partitions. Null and empty texts are the end id alone;
    a null id stays null; repeated rows are packed as often as they are there; an empty table
    gives no row; other columns are ignored. Rows of one id whose texts have one length and one 64-bit hash are taken for equal.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(nfc(text_col), F.lit(""))
    doc_id = nfc(id_col).cast("long")
    rows = docs.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), text.alias("text"))
    places = staged(plan_places(rows.drop("text"), plan_bytes), "packing-places")
    size = places.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    texts = rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    planned = (texts.join(places, _KEY).repartition(partitions_for(spark, size), "plan").sortWithinPartitions("plan", F.desc("no_id"), "id", "h", "size")
               .select("plan", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "copies", "text"))
    return planned.mapInArrow(_pack(vocabulary or default_vocabulary(), window, end_id),
                              "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
