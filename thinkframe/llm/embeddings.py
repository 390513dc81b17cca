"""Operator 1: near-duplicate embeddings by random-hyperplane sign hashing in several tables.

A table names a vector by the signs of its products with some random
hyperplanes; vectors at a small angle get equal names in at least one table
with a probability set by ``plan_tables``. Vectors that share a name are verified by
exact cosine; links join into components. Equal vectors are one point with a count. A
pair is counted only in the first table in which it meets, so counts need no list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import ship_package, staged

#: The chance that a pair just at the threshold is found in no table.
MISS = 1e-7
#: Members of a name that one task verifies against each other; larger names go in pairs of such blocks.
BLOCK = 512


def plan_tables(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(signs a table, tables): a name for an eighth of a row on average, and tables enough for the miss rate."""
    bits = min(30, max(8, math.ceil(math.log2(max(rows, 1))) + 3))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list array of equal lengths."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _names(bits: int, tables: int, seed: int):
    def run(batches):
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column("vec")
            dims = vectors.value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 2048)):
                    rows = batch.take(pa.array(part))
                    signs = _matrix(rows.column("vec")) @ hyperplanes(dim, bits, tables, seed) >= 0
                    names = signs.reshape(len(part), tables, bits) @ weight
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, names.size + 1, tables, dtype=np.int32)), pa.array(names.astype(np.int32).ravel()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "names"])
    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            out_a, out_b, out_w = [], [], []
            for table, members in zip(batch.column("t").to_pylist(), batch.column("members")):
                m = members.values
                _bucket(table, m.field("point").to_numpy(), m.field("copies").to_numpy(), m.field("mine").to_numpy(),
                        _matrix(m.field("vec")), _matrix(m.field("names")).astype(np.int64), threshold, out_a, out_b, out_w)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_w, pa.int64())], ["a", "b", "w"])
    return run


def _bucket(table, points, copies, block, vectors, names, threshold, out_a, out_b, out_w):
    """Link weights (a, a, w) and a spanning forest (a, b, 0) of the pairs that meet here first."""
    order = np.argsort(points)
    points, copies, block, names = points[order], copies[order], block[order], names[order]
    unit = vectors[order] / np.linalg.norm(vectors[order], axis=1)[:, None]
    cross = len(np.unique(block)) > 1
    parent, weight = list(range(len(points))), np.zeros(len(points), dtype=np.int64)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(points) - 1):
        near = np.flatnonzero(unit[i + 1:] @ unit[i] >= threshold) + i + 1
        if cross:
            near = near[block[near] != block[i]]
        if table and len(near):
            near = near[~(names[near, :table] == names[i, :table]).any(axis=1)]
        weight[near] += copies[i]
        weight[i] += copies[near].sum()
        for j in near.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out_a.append(int(points[x])), out_b.append(int(points[y])), out_w.append(0)
    for i in np.flatnonzero(weight).tolist():
        out_a.append(int(points[i])), out_b.append(int(points[i])), out_w.append(int(weight[i]))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, seed: int = 5, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors are of one
    length and their cosine in double precision is at least ``threshold``. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a
    null id. ``component_id`` is the smallest id reachable by links. Repeated
    rows link with each other; an empty table gives an empty result;
    other columns are ignored. A pair at the threshold is missed with probability
    ``miss``, a closer one more rarely.
    """
    ship_package(vectors.sparkSession)
    v = F.col(vector_col)
    sound = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0)
             & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          F.when(F.coalesce(sound, F.lit(False)), v.cast("array<double>")).alias("vec"))
    rows = staged(base.withColumn("point", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))), "vectors")
    points = rows.where("point is not null").groupBy("point", "label").agg(
        F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"), F.min("vec_id").alias("least"))
    points = staged(points, "points")
    most = points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(most, threshold, miss)
    named = staged(points.drop("least").repartition("point").mapInArrow(
        _names(bits, tables, seed), "point long, label " + points.schema["label"].dataType.simpleString() + ", copies long, vec array<double>, names array<int>"), "named")
    key = ["label", "d", "t", "name"]
    met = named.select("point", "label", F.size("vec").alias("d"), F.posexplode("names").alias("t", "name"))
    shared = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = (met.join(shared, key).withColumn("c", F.ceil(F.col("n") / BLOCK).cast("int"))
             .withColumn("mine", F.pmod(F.xxhash64("point"), "c").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))))
    full = dealt.join(named.select("point", "copies", "vec", "names"), "point")
    buckets = full.groupBy(*key, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).agg(
        F.collect_list(F.struct("point", "copies", "mine", "vec", "names")).alias("members"))
    found = staged(buckets.select("t", "members").mapInArrow(_verify(threshold), "a long, b long, w long"), "found")
    links = found.where("a = b").groupBy(F.col("a").alias("point")).agg(F.sum("w").alias("w"))
    groups = components(found.where("a <> b")).select(F.col("v").alias("point"), F.col("label").alias("group"))
    named_points = staged(points.select("point", "copies", "least").join(links, "point", "left").join(groups, "point", "left")
                          .select("point", "least", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"),
                                  F.coalesce("group", "point").alias("group")), "linked")
    least = named_points.groupBy("group").agg(F.min("least").alias("component_id"))
    result = named_points.join(least, "group").select("point", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(result, "point", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"))
