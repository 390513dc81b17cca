"""Operator 10: exact Jaccard join of word-shingle sets by a metric-space partition.

The Jaccard distance 1 - |x & y| / |x | y| is a metric. Equal sets are one
point. Two cheap exact tests leave only points that can have a partner, and
points that share a rare shingle fall into one region. A region is joined
recursively: pivots split it into Voronoi cells, a point enters every
cell whose radius plus the threshold reaches it (triangle inequality), and
a cell that no longer splits is measured point by point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import nfc, ship_package, staged
from .words import mix, shingle_sets, text_slices, word_hashes, word_spans

#: Points of a region joined in one task; larger regions are joined block by block.
BLOCK_SHINGLES = 4_000_000
_LEAF = 48
_PIVOTS = 8


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def _sets(batches, k) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        for lo, data, offsets in text_slices(batch.column(1)):
            starts, ends, first = word_spans(data, offsets)
            yield batch, lo, list(shingle_sets(word_hashes(data, starts, ends), first, k))


def _flat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_flat(sets).view(np.int64)))


def _set_id(s: np.ndarray) -> int:
    """The 64-bit name of a set, 0 for the empty one."""
    return int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


def _profile(k: int):
    def run(batches):
        for batch, lo, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, len(sets)), batch.column("th").slice(lo, len(sets)),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_set_id, sets), pa.int64())],
                ["doc_id", "th", "n", "point"])
    return run


def _probe(k: int, percent: int):
    """The first shingles by hash of each set: any partner shares at least ``need`` of them."""
    def run(batches):
        for _, _, sets in _sets(batches, k):
            sets = [s for s in sets if len(s)]
            ids = [_set_id(s) for s in sets]
            cut = [s[:len(s) - least_overlap(len(s), percent) + _need(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_flat(cut).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(c) for c in cut]))],
                ["key", "point"])
    return run


def _need(n: int) -> int:
    return -(-n // 8)


def _full(k: int):
    def run(batches):
        for batch, lo, sets in _sets(batches, k):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_set_id, sets), pa.int64()), _lists(sets)], ["v", "set"])
    return run


class _Region:
    """Points of one region or block, measured through posting lists of their shared shingles."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.percent = percent
        own = np.repeat(np.arange(len(sets)), self.n)
        _, key, df = np.unique(_flat(sets), return_inverse=True, return_counts=True)
        kept = df[key] > 1
        own, key = own[kept], key[kept]
        self.first = np.searchsorted(own, np.arange(len(sets) + 1))
        self.key = key
        order = np.argsort(key, kind="stable")
        self.post = own[order]
        self.post_first = np.searchsorted(key[order], np.arange(len(df) + 1))
        self.parent = list(range(len(sets)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def distances(self, i: int, among: np.ndarray) -> np.ndarray:
        """Distance of point i to every point of ``among``; links found on the way are recorded."""
        keys = self.key[self.first[i]:self.first[i + 1]]
        a, b = self.post_first[keys], self.post_first[keys + 1]
        size = b - a
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        shared = np.bincount(self.post[at], minlength=len(self.n))[among]
        union = self.n[i] + self.n[among] - shared
        for j in among[100 * shared >= self.percent * union].tolist():
            x, y = self.root(i), self.root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        return 1 - shared / union

    def join(self) -> None:
        eps = 1 - self.percent / 100
        todo = [np.arange(len(self.n))]
        while todo:
            cell = todo.pop()
            roots = np.array([self.root(x) for x in cell.tolist()])
            if len(cell) < 2 or (roots == roots[0]).all():
                continue
            if len(cell) > _LEAF:
                pivots = cell[np.linspace(0, len(cell) - 1, _PIVOTS).astype(int)]
                d = np.stack([self.distances(p, cell) for p in pivots.tolist()])
                near, least = d.argmin(0), d.min(0)
                parts, home = [], np.where(least <= 0.5, near, -1)
                for i in range(len(pivots)):
                    inside = home == i
                    if inside.any():
                        parts.append(cell[inside | (d[i] <= d[i][inside].max() + eps + 1e-9)])
                # A far point meets a far point here, and any other inside that one's cell.
                parts.append(cell[home == -1])
                if max(len(p) for p in parts) < 0.9 * len(cell):
                    todo.extend(parts)
                    continue
                roots = np.array([self.root(x) for x in cell.tolist()])
            values, count = np.unique(roots, return_counts=True)
            largest = values[count.argmax()]
            # Points of the largest component need no measuring among themselves.
            for x in cell[roots != largest].tolist():
                self.distances(x, cell)


def _join_blocks(percent: int):
    def run(key, table):
        table = table.combine_chunks()
        ids = table.column("v").to_numpy()
        order = np.argsort(mix(ids.astype(np.uint64)))
        lists = table.column("set").chunk(0)
        flat, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        region = _Region([flat[offsets[i]:offsets[i + 1]] for i in order], percent)
        region.join()
        roots = np.array([region.root(x) for x in range(len(ids))])
        linked = np.flatnonzero(roots != np.arange(len(ids)))
        return pa.table({"a": ids[order[linked]], "b": ids[order[roots[linked]]]})
    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``, see ``row_components``."""
    return row_components(docs, id_col, text_col, k, percent).drop("th", "group")


def row_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, th, group, n_shingles, component_id) for every row of ``docs``: ``th`` hashes the text (null: 42) and ``group`` names the component, so
    rows that share an id are told apart.

    Documents whose shingle sets have 100 * |x & y| >= percent * |x | y| are
    linked; ``component_id`` is the smallest id reachable by links.
    A null or wordless text has no shingles and links with nothing. A row
    with a null id has a null component, and no link goes through a set that only such rows hold. Repeated rows stay repeated; an empty table
    gives an empty result; other columns are ignored. Shingles and sets go by
    64-bit hashes.
    """
    ship_package(docs.sparkSession)
    source = docs.select(nfc(id_col).cast("long").alias("doc_id"), nfc(text_col).alias("text"))
    profile = staged(source.withColumn("th", F.xxhash64("text")).mapInArrow(_profile(k), "doc_id long, th long, n long, point long"), "profile")
    # 1. A set is a candidate if enough of its first shingles occur in another set. Copies of one set are one point.
    probe = source.mapInArrow(_probe(k, percent), "key long, point long").where("key is not null")
    # Least and largest points are found in each task and written first, so that the join is a plain one whose hot keys Spark splits over tasks.
    shared = staged(probe.groupBy("key").agg(F.min("point").alias("lo"), F.max("point").alias("hi")).where("lo <> hi").select("key"), "shared")
    hits = probe.join(shared, "key").groupBy("point").agg(F.count(F.lit(1)).alias("hits"))
    points = profile.where("n > 0").groupBy("point").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    able = staged(points.join(hits, "point").where(F.col("hits") >= F.col("copies") * F.ceil(F.col("n") / 8))
                  .select("doc_id"), "able")
    sets = staged(source.join(able, "doc_id", "left_semi").mapInArrow(_full(k), "v long, set array<long>"), "sets")
    # 2. Among candidates, the rarest shingles come first: any two partners share one of the first n - overlap + 1.
    rows = sets.select("v", F.size("set").alias("n"), F.explode("set").alias("key"))
    df = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = rows.join(df, "key").groupBy("v").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "key"))).alias("ks"))
    front = F.size("ks") - F.ceil(F.col("n") * F.lit(percent) / F.lit(100)).cast("int") + 1
    keys = staged(ranked.where(front > 0).select("v", F.explode(F.slice("ks", 1, front)["key"]).alias("key")), "keys")
    lead = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v"))["v"].alias("lead"))
    regions = components(keys.join(lead, "key").where(F.col("v") != F.col("lead")).select(F.col("v").alias("a"), F.col("lead").alias("b")))
    # 3. Regions, or blocks of large ones, are joined exactly.
    placed = sets.join(regions, "v")
    weight = placed.groupBy("label").agg(F.sum(F.size("set")).alias("w"))
    split = placed.join(weight, "label").withColumn("c", F.ceil(F.col("w") / BLOCK_SHINGLES).cast("int"))
    split = split.withColumn("mine", F.pmod(F.xxhash64("v"), "c").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    blocks = split.select("label", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "v", "set")
    groups = components(blocks.groupBy("label", "x", "y").applyInArrow(_join_blocks(percent), "a long, b long"))
    named = points.join(groups, points["point"] == groups["v"], "left").select("point", "doc_id", F.coalesce("label", "point").alias("c"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(least, "c").select("point", F.col("c").alias("group"), "component_id")
    return (profile.join(ids, "point", "left")
            .select("doc_id", "th", "group", F.col("n").alias("n_shingles"),
                    F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
