"""Operator 12: a Merkle manifest of a dataset, with an inclusion proof for every row.

Each group of rows (a tree) is ordered and hashed to leaves. A level of a tree is a
table of nodes (tree, idx, n, digest): every node finds the others of its run by an equijoin with
their computed indices (XOR 1 for binary trees, slot offsets otherwise), and the
nodes of slot zero emit their parents. The roots of the trees, in order, are
the leaves of one more tree. Proofs go down again, level by level, each node's path being its siblings before its parent's path.
Digests are SHA-256 over digests as lowercase hex text; tables hold them as 32 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import nfc, staged

_NODE = ["tree", "idx", "n", "digest"]


def field_text(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value: no two field lists share a text."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the fields' texts."""
    return F.sha2(F.concat(*[field_text(c) for c in columns]), 256)


def _hex(column) -> Column:
    return F.lower(F.hex(column))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (gapless from 0 within ``tree``, in ``order``) and ``n`` (the tree's rows).

    Rows are dealt by ranges of (tree, order) and numbered inside a range; ranges are counted, and each
    is set behind the ones before it in its tree. Equal rows are told apart by where they stand, so they may
    fill many ranges. No task sees more than a range, nor more counts of a tree than there are ranges.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    placed = staged(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).alias("_part")
    ranges = placed.groupBy("tree", part).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_c"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_c").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("tree", "_part", (before - F.col("_least")).alias("_shift"), F.sum("_c").over(tree).alias("n"))
    return (placed.withColumn("_part", part).join(offsets, ["tree", "_part"])
            .withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def with_siblings(nodes: DataFrame, arity: int = 2) -> DataFrame:
    """``nodes`` with ``others``: the digests of the rest of their run, left to right; empty if alone, null for a finished tree (n = 1).

    One equijoin a sibling, on its computed index.
    """
    out, found = nodes, []
    slot = F.col("idx") % arity
    for shift in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        near = nodes.select("tree", F.col("idx").alias("_at"), F.struct(F.col("idx").alias("i"), "digest").alias(f"_s{shift}"))
        out = out.withColumn("_at", sibling).join(near, ["tree", "_at"], "left").drop("_at")
        found.append(f"_s{shift}")
    run = F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda s: _hex(s["digest"]))
    return out.withColumn("others", F.when(F.col("n") > 1, F.unhex(F.concat_ws("", run)))).drop(*found)


def parents(level: DataFrame, arity: int = 2) -> DataFrame:
    """The nodes above ``level`` (with ``others``): slot zero hashes its run; the root of a finished tree goes up as it is."""
    digest = F.when(F.col("others").isNull(), F.col("digest")).otherwise(_sha(F.concat(_hex("digest"), _hex("others"))))
    return level.where(F.col("idx") % arity == 0).select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest.alias("digest"))


def tree_levels(leaves: DataFrame, arity: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves upwards, each with ``others``; roots as nodes): a join and a written table a level."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while most > 1:
        levels.append(staged(with_siblings(nodes, arity), "level", free=not levels))
        nodes, most = parents(levels[-1], arity), -(-most // arity)
    return levels, nodes.select(*_NODE)


def paths_down(levels: list[DataFrame], top: DataFrame, arity: int = 2) -> DataFrame:
    """The lowest level with ``up`` (``others`` of each level from there to the root) and the columns that ``top`` (tree, ...) has for its tree."""
    extra = [c for c in top.columns if c != "tree"]
    paths = top.withColumn("idx", F.lit(0).cast("long")).withColumn("up", F.array().cast("array<binary>"))
    for level in reversed(levels):
        rest = [c for c in level.columns if c not in ("tree", "idx", "others")]
        own = level.withColumn("_up", F.expr(f"idx div {arity}"))
        above = paths.select("tree", F.col("idx").alias("_up"), F.col("up").alias("_above"), *extra)
        paths = own.join(above, ["tree", "_up"]).select("tree", "idx", *rest, F.concat(F.array("others"), "_above").alias("up"), *extra)
    return paths


def folded(leaf: Column, idx: Column, up: Column, arity: int = 2) -> Column:
    """Hex digest of the root that follows from a hex leaf at ``idx`` and its siblings ``up``."""
    def step(state, others):
        at = (state["i"] % arity * 64).cast("int")
        sides = _hex(others)
        joined = F.concat(F.substring(sides, F.lit(1), at), state["h"], F.substring(sides, at + 1, F.length(sides)))
        return F.struct(F.when(others.isNull(), state["h"]).otherwise(F.sha2(joined, 256)).alias("h"), F.floor(state["i"] / arity).cast("long").alias("i"))
    return F.aggregate(up, F.struct(leaf.alias("h"), idx.alias("i")), step, lambda s: s["h"])


def manifest(leaves: DataFrame, order: list[str], arity: int = 2) -> DataFrame:
    """``leaves`` (tree, digest, any columns) with idx, n, up (siblings to the subroot), top_idx, top_up (from the subroot to the root), subroot and root.

    Leaves of a tree are ordered by ``order`` (nulls first), trees by their name's bytes.
    """
    leaves = staged(numbered(leaves, order), "leaves")
    levels, roots = tree_levels(leaves, arity)
    roots = staged(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots")
    upper = staged(numbered(roots, ["name"]), "upper")
    top_levels, top_root = tree_levels(upper.select(*_NODE, "name"), arity)
    top = paths_down(top_levels, top_root.select("tree", F.col("digest").alias("root")), arity) if top_levels else (
        upper.withColumn("up", F.array().cast("array<binary>")).withColumn("root", F.col("digest")))
    known = staged(top.select(F.col("name").alias("tree"), F.col("idx").alias("top_idx"), F.col("up").alias("top_up"), F.col("digest").alias("subroot"), "root"), "top")
    if levels:
        return paths_down(levels, known, arity)
    return leaves.join(known, "tree").withColumn("up", F.array().cast("array<binary>"))


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", tree_col: str = "lang",
                    tampered_col: str = "n_chars", every: int = 7, arity: int = 2) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    A leaf hashes ``columns``. Trees are the values of ``tree_col`` (null first, then by UTF-8 bytes; null and the empty string are two trees);
    in a tree, rows ascend by ``id_col`` (null first), rows of one id by their leaf, equal rows hold places of their own. As an audit, rows of
    which ``every`` divides the CRC-32 of the id's decimal text are folded with 1 added to ``tampered_col`` (a null stays; a null id is never
    tampered with). Null fields are ``-``; an empty table gives an empty result; other columns are ignored.
    """
    def field(name, add=0):
        return nfc(name).cast("decimal(20,0)") + add if add else nfc(name)

    hit = (F.crc32(nfc(id_col).cast("string")) % every == 0) & nfc(tampered_col).isNotNull()
    changed = F.when(hit, F.unhex(row_digest([field(c, int(c == tampered_col)) for c in columns])))
    name = F.when(nfc(tree_col).isNull(), "").otherwise(F.concat(F.lit("+"), nfc(tree_col).cast("string")))
    leaves = staged(docs.select(name.alias("tree"), nfc(id_col).cast("long").alias("doc_id"), F.unhex(row_digest([field(c) for c in columns])).alias("digest"), changed.alias("changed")), "hashed")
    rows = manifest(leaves, ["doc_id", "digest"], arity)
    siblings = F.concat(F.concat_ws("", F.transform("up", _hex)), F.concat_ws("", F.transform("top_up", _hex)))
    start = F.coalesce(_hex("changed"), _hex("digest"))
    root = folded(folded(start, F.col("idx"), F.col("up"), arity), F.col("top_idx"), F.col("top_up"), arity)
    return (rows.select("doc_id", _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"),
                        F.sha2(siblings, 256).alias("proof_sha256"), root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
