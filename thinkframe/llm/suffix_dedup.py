"""Operator 9: removal of repeated byte strings of a bounded length.

Every window of ``length`` bytes belongs to the group of its anchor, so only groups
are compared. A run of windows with one anchor is a piece; equal pieces are counted
together and all but the first go. Different pieces of one anchor are compared in
blocks: a Burrows-Wheeler transform of the block is extended backwards breadth
first, which yields the common-prefix values 0, 1, 2, ... in that order and
stops at ``length``; neighbours still without a value begin with the same window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import K, anchor_runs, prefix_sums
from .staging import nfc, ship_package, staged
from .words import _powers, mix, text_slices

LENGTH = 100
#: Bytes compared in one block, and pieces of one anchor beyond which it takes blocks of its own.
BLOCK_BYTES, HOT_PIECES = 1_000_000, 4096
_LEAST = -(2**63)
_SYMBOLS = 7  # nine-bit symbols in a 63-bit key


def _runs(length: int):
    def run(batches):
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column("text")):
                text, at, n, place, anchor = anchor_runs(data, offsets, length)
                if not len(at):
                    continue
                power, inverse = _powers(len(data) + 1)
                sums = prefix_sums(data, power)
                off = place - at
                content = (sums[at + n + length - 1] - sums[at]) * inverse[at]
                piece = mix(content + (n * 65536 + off).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rows = batch.slice(lo, len(offsets) - 1)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), rows.column("d").take(take), rows.column("th").take(take),
                     pa.array(_place(at - offsets[text], n, off))], ["anchor", "piece", "d", "th", "place"])
    return run


def _place(at, n, off):
    """Where a piece starts in its text, its windows and its anchor's offset in one number, ordered by the start."""
    return at << 24 | n << 12 | off


def _cut(length: int):
    """Bytes of the listed pieces of each text."""
    def run(batches):
        for batch in batches:
            texts, wanted = batch.column("text"), batch.column("wanted")
            for row in range(batch.num_rows):
                data, items = texts[row].as_buffer().to_pybytes(), wanted[row].values
                place = items.field("place").to_numpy()
                at, n = place >> 24, place >> 12 & 4095
                yield pa.RecordBatch.from_arrays(
                    [items.field("anchor"), items.field("piece"), pa.repeat(batch.column("d")[row], len(place)), pa.repeat(batch.column("th")[row], len(place)),
                     items.field("place"), pa.array([data[a:a + k + length - 1] for a, k in zip(at.tolist(), n.tolist())], pa.binary())],
                    ["anchor", "piece", "d", "th", "place", "bytes"])
    return run


def _bounded_order(s: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of ``s`` (symbols under 512) sorted by their first ``length`` symbols or more, by prefix doubling."""
    n = len(s)
    padded = np.zeros(n + _SYMBOLS, dtype=np.int64)
    padded[:n] = s
    key = np.zeros(n, dtype=np.int64)
    for j in range(_SYMBOLS):
        key = key << 9 | padded[j:n + j]
    span = _SYMBOLS
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.empty(n, dtype=bool)
        fresh[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
        if span >= length or fresh.all():
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        ahead = np.zeros(n, dtype=np.int64)
        ahead[:n - span] = rank[span:]
        key = rank * (n + 1) + ahead
        span *= 2


def prefix_classes(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes in order, and whether one differs from its predecessor within ``length`` symbols.

    ``first`` is found by breadth-first backward extension: if a boundary b has
    the common-prefix value v, then the first place at or after b where a
    character c precedes a suffix leads to a boundary of value v + 1 among suffixes that begin with c, if it has no smaller one yet.
    """
    n = len(s)
    order = _bounded_order(s, length)
    bwt = s[order - 1].astype(np.uint16)  # the character before each suffix; the first suffix is preceded by the last, a separator
    by_char = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)  # where the suffix one longer stands
    step[by_char] = np.arange(n)
    previous = np.full(n, -1, dtype=np.int64)  # the place before with the same character
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    previous[by_char[1:][same]] = by_char[:-1][same]
    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    fresh = np.zeros(1, dtype=np.int64)
    for _ in range(length):
        bounds = np.flatnonzero(known)
        ends = bounds[np.searchsorted(bounds, fresh, side="right")]
        size = ends - fresh
        at = np.arange(size.sum()) + np.repeat(fresh - (np.cumsum(size) - size), size)
        at = at[previous[at] < np.repeat(fresh, size)]
        to = step[at]
        fresh = np.sort(to[~known[to]])
        if not len(fresh):
            break
        known[fresh] = True
    return order, known[:n]


def _shared_sides(anchor, parts, off, length):
    """Pieces of which another piece of the anchor has the same bytes just before or just after the anchor, as any with a common window has."""
    half = (length - K + 1) // 2
    keep = np.zeros(len(parts), dtype=bool)
    for before in (True, False):
        seen: dict = {}
        for i, (a, p, o) in enumerate(zip(anchor.tolist(), parts, off.tolist())):
            side = p[o - half:o] if before else p[o + K:o + K + half]
            if len(side) == half and (not before or o >= half):
                other = seen.setdefault((a, side), i)
                if other != i:
                    keep[i] = keep[other] = True
    return np.flatnonzero(keep)


def _compare(length: int):
    def run(key, table):
        table = table.combine_chunks()
        anchor, d, th, place = (table.column(c).to_numpy() for c in ("anchor", "d", "th", "place"))
        hot = table.column("hot").to_numpy(zero_copy_only=False)
        # A repeated row brings its pieces again; (anchor, piece) names them.
        _, once = np.unique(np.stack([anchor, table.column("piece").to_numpy()]), axis=1, return_index=True)
        parts = table.column("bytes").to_pylist()
        out = {c: [] for c in ("d", "th", "lo", "hi", "w1", "w2")}

        def put(i, lo, hi, w1, w2):
            for c, v in zip(out, (d[i], th[i], lo, hi, w1, w2)):
                out[c].append(v)

        kept = once if hot.any() else once[_shared_sides(anchor[once], [parts[i] for i in once], place[once] & 4095, length)]
        if len(kept):
            kept = kept[np.lexsort((place[kept], th[kept], d[kept]))]  # earlier pieces first
            s = np.frombuffer(b"\0".join(parts[i] for i in kept) + b"\0", dtype=np.uint8).astype(np.int64) + 1
            size = np.array([len(parts[i]) for i in kept])
            starts = np.cumsum(size + 1) - size - 1
            s[starts + size] = 0
            order, first = prefix_classes(s, length)
            group = np.empty(len(s), dtype=np.int64)
            group[order] = np.cumsum(first)
            windows = size - length + 1
            owner = np.repeat(np.arange(len(kept)), windows)
            rel = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            where = starts[owner] + rel
            begin = (place[kept] >> 24)[owner] + rel
            g = group[where]
            # Rows of a group in reading order; its first window stays.
            rank = np.lexsort((begin, th[kept][owner], d[kept][owner], g))
            later = np.empty(len(rank), dtype=bool)
            later[:1] = False
            np.equal(g[rank][1:], g[rank][:-1], out=later[1:])
            gone = np.zeros(len(rank), dtype=bool)
            gone[rank[later]] = True
            at = np.flatnonzero(gone)
            if len(at):
                new = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(owner[at]) > 0)))
                for a, b in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist()):
                    put(kept[owner[a]], begin[a], begin[b] + length, None, None)
            if hot.any():
                for a in np.flatnonzero(~gone & hot[kept][owner]).tolist():
                    h = hashlib.blake2b(s[where[a]:where[a] + length].astype(np.uint16).tobytes(), digest_size=16).digest()
                    put(kept[owner[a]], begin[a], begin[a] + length, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True))
        return pa.table({c: pa.array(v, pa.int32() if c == "th" else pa.int64()) for c, v in out.items()})
    return run


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, th, spans): for each text of ``keyed`` (d, th, text) with repeats, the windows' byte ranges that occur earlier (may overlap)."""
    ship_package(keyed.sparkSession)
    runs = keyed.mapInArrow(_runs(length), "anchor long, piece long, d long, th int, place long").where("anchor is not null")
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("piece").alias("p"), F.max("piece").alias("q")).where("n > 1")
    # Counts are added up in each task and written first, so that the join is a plain one whose hot anchors Spark splits over tasks.
    often = staged(often.select("anchor", (F.col("p") != F.col("q")).alias("mixed")), "often")
    rows = staged(runs.join(often, "anchor"), "runs")
    firsts = staged(rows.groupBy("anchor", "piece", "mixed").agg(F.min(F.struct("d", "th", "place")).alias("f"), F.count(F.lit(1)).alias("n")), "firsts")
    # 1. Of equal pieces the first stays whole.
    again = firsts.where("n > 1").select("anchor", "piece", "f")
    whole = rows.join(again, ["anchor", "piece"]).where(F.struct("d", "th", "place") != F.col("f"))
    start, windows = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(4095)
    whole = whole.select("d", "th", start.alias("lo"), (start + windows + (length - 1)).alias("hi"))
    # 2. Different pieces of an anchor, each where it occurs first.
    border = firsts.where("mixed").select("anchor", "piece", "f.*")
    counts = border.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total * (length + 40) // BLOCK_BYTES))
    wanted = border.groupBy("d", "th").agg(F.collect_list(F.struct("anchor", "piece", "place")).alias("wanted"))
    cut = keyed.join(wanted, ["d", "th"]).select("d", "th", "text", "wanted").mapInArrow(
        _cut(length), "anchor long, piece long, d long, th int, place long, bytes binary")
    parts = F.ceil(F.col("n") / HOT_PIECES)
    dealt = cut.join(counts, "anchor").withColumn("hot", parts > 1).withColumn(
        "block", F.when(parts > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(blocks)))).withColumn("sub", F.pmod("piece", parts))
    found = staged(dealt.groupBy("hot", "block", "sub").applyInArrow(
        _compare(length), "d long, th int, lo long, hi long, w1 long, w2 long"), "found")
    # 3. An anchor with too many pieces for one block: the first of each block meet by their window.
    across = found.where("w1 is not null")
    least = across.groupBy("w1", "w2").agg(F.min(F.struct("d", "th", "lo")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = across.join(least, ["w1", "w2"]).where(F.struct("d", "th", "lo") != F.col("f")).select("d", "th", "lo", "hi")
    spans = whole.unionByName(found.where("w1 is null").select("d", "th", "lo", "hi")).unionByName(late)
    return spans.groupBy("d", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given byte ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def _apply(batches):
    """Cut the spans out: digest columns, the bytes left, and the runs removed."""
    for batch in batches:
        out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            n, removed, kept = 0, 0, data
            if spans.is_valid:
                lo, hi = merged(spans.values.field("lo").to_numpy(), spans.values.field("hi").to_numpy())
                n, removed = len(lo), int((hi - lo).sum())
                kept = b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)]))
            for c, v in zip(out, (len(data), removed, n, hashlib.sha256(kept).hexdigest())):
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], ["doc_id", *out])


def _strip(batches):
    """Texts without the removed runs; a character goes only if all its bytes do."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            if not (text.is_valid and spans.is_valid):
                texts.append(text.as_py())
                continue
            data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            lead = np.append((data & 0xC0) != 0x80, True)
            at = np.flatnonzero(lead)
            lo, hi = merged(spans.values.field("lo").to_numpy(), spans.values.field("hi").to_numpy())
            lo, hi = at[np.searchsorted(at, lo)], at[np.searchsorted(at, hi, side="right") - 1]
            keep = np.ones(len(data), dtype=bool)
            for a, b in zip(lo.tolist(), hi.tolist()):
                keep[a:b] = False
            texts.append(data[keep].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n != "spans"],
                                         [n for n in batch.schema.names if n != "spans"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """A text goes by its id and a hash, so that repeated ids with other texts stay apart; null ids come first."""
    text = F.coalesce(nfc(text_col), F.lit(""))
    return docs.select(F.coalesce(nfc(id_col).cast("long"), F.lit(_LEAST)).alias("d"), F.hash(text).alias("th"), text.alias("text"), *more)


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
    smaller id, or before in the same text. Strings are judged on the input. Null and
    empty texts have no bytes. Rows equal in id and text count as one text and
    get equal results; an empty table gives an empty result; other columns are ignored.
    Anchors and pieces are told apart by 64-bit hashes.
    """
    spans = staged(repeated_spans(_keyed(docs, id_col, text_col).where("text <> ''"), length), "spans")
    rows = _keyed(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id")).join(spans, ["d", "th"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with each text (column ``text_col``) stripped of its repeated strings; whole characters only, so it stays valid UTF-8."""
    spans = staged(repeated_spans(_keyed(docs, id_col, text_col).where("text <> ''"), length), "spans")
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.coalesce(nfc(id_col).cast("long"), F.lit(_LEAST)).alias("_d"), F.hash(F.coalesce(nfc(text_col), F.lit(""))).alias("_th"),
                       nfc(text_col).alias("text"), *[nfc(c).alias(f"c{i}") for i, c in enumerate(rest)])
    joined = rows.join(spans.withColumnsRenamed({"d": "_d", "th": "_th"}), ["_d", "_th"], "left").drop("_d", "_th")
    schema = joined.drop("spans").schema
    out = joined.select(*schema.names, "spans").mapInArrow(_strip, schema)
    names = dict(zip(rest, [f"c{i}" for i in range(len(rest))]))
    return out.select(*[F.col("text" if c == text_col else names[c]).alias(c) for c in docs.columns])
