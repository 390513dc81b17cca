"""Operator 3: sharding by minimax contiguous partition, with DataFrame operations only.

Equal texts are one atomic group; groups are ordered by the hash of their
text. The smallest capacity for which a greedy walk needs no more
shards than asked for is found by binary search. The walk does not see
every group: the driver holds a bounded histogram of hash ranges and refines
only the ranges in which a cut may fall, until the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: The histogram starts with 2^FIRST_BITS hash ranges; a refinement splits a range into 2^STEP_BITS.
FIRST_BITS, STEP_BITS, HASH_BITS = 14, 5, 60
_CELL_ROWS = 4096


class _Histogram:
    """Sizes of hash ranges in order: ``lows`` (first hash), ``sizes``, and whether a range is one group."""

    def __init__(self, ranges: list[tuple[int, int, int, bool]]):
        self.ranges = sorted(ranges)
        self.single = [r[3] for r in self.ranges]
        self.ends = list(accumulate(r[2] for r in self.ranges))
        self.total = self.ends[-1] if self.ends else 0

    def reach(self, start: int, capacity: int, cut_inside: bool) -> int:
        """How far a shard that begins at ``start`` gets; a range of several groups may be cut inside only if ``cut_inside``."""
        goal = start + capacity
        i = bisect_right(self.ends, goal)
        if i == len(self.ends):
            return self.total
        whole = self.ends[i - 1] if i else 0
        return goal if cut_inside and not self.single[i] else max(whole, start)

    def walk(self, capacity: int, shards: int, cut_inside: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, cut_inside)
            out.append(at)
        return out

    def least(self, shards: int, low: int, high: int, cut_inside: bool) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, cut_inside)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low


def _totals(groups: DataFrame, width: int) -> DataFrame:
    low = F.shiftleft(F.shiftrightunsigned("h", width), width)
    return (groups.groupBy(low.alias("low"), F.lit(width).alias("width"))
            .agg(F.sum("bytes").cast("long").alias("size"), F.max("bytes").alias("largest"), F.count(F.lit(1)).alias("n")))


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First hash of shards 1, 2, ... (``groups``: h of 60 bits, bytes): no contiguous partition has a smaller largest shard.

    Under that capacity the cuts keep shards near the mean of what is left.
    """
    first = HASH_BITS - FIRST_BITS
    rows = _totals(groups, first).collect()  # at most 2^FIRST_BITS rows
    largest = max((r.largest for r in rows), default=0)
    ranges = {(r.low, r.width): (r.size, r.n == 1) for r in rows}
    while True:
        hist = _Histogram([(low, width, *v) for (low, width), v in ranges.items()])
        floor = max(largest, -(-hist.total // shards))
        low = hist.least(shards, floor, max(hist.total, floor), True)
        high = hist.least(shards, low, max(hist.total, low), False)
        if low >= high:
            break
        # A cut lies between where whole ranges at the low and free cuts at the high capacity can get.
        spans = list(zip(hist.walk(low, shards, False), hist.walk(high, shards, True)))
        open_ = sorted({i for a, b in spans for i in range(bisect_right(hist.ends, a), min(len(hist.ends), bisect_right(hist.ends, b) + 1)) if not hist.single[i]})
        if not open_:
            break
        picked = [hist.ranges[i] for i in open_]
        width = max(r[1] for r in picked)
        picked = [r for r in picked if r[1] == width]
        spark = groups.sparkSession
        wanted = spark.createDataFrame([(r[0],) for r in picked], "low long")  # bounded by the histogram
        inside = groups.withColumn("low", F.shiftleft(F.shiftrightunsigned("h", width), width)).join(F.broadcast(wanted), "low").drop("low")
        for r in picked:
            del ranges[r[0], r[1]]
        for r in _totals(inside, max(0, width - STEP_BITS)).collect():
            ranges[r.low, r.width] = (r.size, r.n == 1)
    return _level(hist, high, shards)


def _level(hist: _Histogram, capacity: int, shards: int) -> list[int]:
    """Cuts under the capacity, each as near as it may be to an equal share of what is left."""
    # latest[k]: the least start from which the last k shards can hold everything.
    latest, at = [hist.total], hist.total
    starts = [0, *hist.ends]
    for _ in range(shards):
        i = bisect_right(starts, at - capacity - 1)
        at = min(at, starts[i]) if i < len(starts) else at
        latest.append(max(at, 0))
    cuts, at = [], 0
    for k in range(shards - 1, 0, -1):
        goal = at + -(-(hist.total - at) // (k + 1))
        i = bisect_right(starts, goal) - 1
        best = starts[i]
        if i + 1 < len(starts) and starts[i + 1] - goal < goal - best:
            best = starts[i + 1]
        best = min(max(best, latest[k], at), hist.reach(at, capacity, False))
        cuts.append(best)
        at = best
    out = []
    for c in cuts:
        i = bisect_right(hist.ends, c)
        out.append(hist.ranges[i][0] if i < len(hist.ranges) else 1 << HASH_BITS)
    return out


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    A row's size is the UTF-8 bytes of its text plus ``overhead``; a null text
    has none and a null crc32, and null texts are a group of their own. Rows of equal texts
    share a shard; the largest shard is as small as contiguous groups allow
    (a group larger than the mean sets it). Slots are gapless from
    0 in each shard. Repeated rows get slots of their own; an empty table gives
    an empty result; other columns are ignored.
    """
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), 64 - HASH_BITS)
    keyed = staged(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), h.alias("h")), "keyed")
    groups = keyed.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = staged(groups, "groups")
    cuts = minimax_cuts(groups.select("h", "bytes"), shards)
    shard = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # A range of hashes is dealt into cells of bounded size by document; slots count through the cells of a shard.
    unit = F.shiftrightunsigned("h", HASH_BITS - FIRST_BITS).alias("unit")
    units = groups.groupBy(unit).agg(F.ceil(F.sum("rows") / _CELL_ROWS).alias("cells"))
    rows = keyed.withColumn("shard", shard).withColumn("unit", unit).join(F.broadcast(units), "unit")  # at most 2^FIRST_BITS units
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), "cells")).drop("cells")
    cells = rows.groupBy("shard", "unit", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("shard", "unit", "cell", F.sum("n").over(
        Window.partitionBy("shard").orderBy("unit", "cell").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    here = F.row_number().over(Window.partitionBy("shard", "unit", "cell").orderBy("doc_id", "h")) - 1
    return (rows.withColumn("here", here).join(before, ["shard", "unit", "cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.coalesce("before", F.lit(0)) + F.col("here")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
