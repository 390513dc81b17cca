"""Operator 13: benchmark passages in training texts, by suffix arrays over the training words.

Each task sorts the word suffixes of its slices of text (the shards) and binary-searches the
suffixes of the benchmark in them: first for the words that fit one packed key, then word by
word inside the interval found, until it is empty. That gives the longest verbatim match of every test
suffix and, at the length of a window, all places of that window. Nothing is shuffled: the benchmark
comes to the tasks in blocks of a bounded size, and a row's hits gather on the row.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import nfc, ship_package, staged
from .words import KeyIndex, text_slices, word_hashes, word_spans

WINDOW = 10
#: Benchmark text of one block, and training text of one suffix array; a longer item or document is a block or a slice alone.
BLOCK_BYTES, SHARD_BYTES = 8_000_000, 2_000_000

#: Words hold ASCII digits, lower-case letters (A-Z count as such) and everything beyond ASCII.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Block:
    """Test items as word ids: ``words`` one after the other, each item ended by a 0."""

    names: list
    vocabulary: np.ndarray  # hash of each word id, from 1
    words: np.ndarray
    starts: np.ndarray  # suffixes that begin a window ...
    window: np.ndarray  # ... its words ...
    rest: np.ndarray    # ... all words to the item's end ...
    item: np.ndarray    # ... and the item


def _hashed(data, offsets):
    begin, end, first = word_spans(data, offsets, _OUTSIDE)
    return word_hashes(data, begin, end), first


def make_block(names: list, texts: pa.Array, window: int = WINDOW) -> Block:
    """The windows of the given items: every ``window`` consecutive words, or the whole of an item with fewer; an item without words has none."""
    hashes, sizes = [], []
    for _, data, offsets in text_slices(texts):
        h, first = _hashed(data, offsets)
        hashes.append(h)
        sizes.append(np.diff(first))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    vocabulary, ids = np.unique(flat, return_inverse=True)
    item = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) + item
    words = np.zeros(len(flat) + len(size) + 1, dtype=np.int64)
    words[place] = ids + 1
    rest = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    whole = np.minimum(size, window)[item]
    at = np.flatnonzero(rest >= whole)
    return Block(names, vocabulary, words, place[at], whole[at], rest[at], item[at])


def packed_words(words: np.ndarray, bits: int, span: int) -> np.ndarray:
    """The ``span`` words from every place in one integer; zeros behind the end."""
    padded = np.zeros(len(words) + span, dtype=np.int64)
    padded[:len(words)] = words
    key = np.zeros(len(words), dtype=np.int64)
    for j in range(span):
        key = key << bits | padded[j:j + len(words)]
    return key


def suffix_array(words: np.ndarray, key: np.ndarray, span: int, depth: int) -> np.ndarray:
    """Suffixes of ``words`` that begin with a word (not 0), by their first ``depth`` words or more.

    ``key`` packs the first ``span``; suffixes still tied are sorted again by the ranks twice as far, only they.
    """
    order = np.flatnonzero(words)
    order = order[np.argsort(key[order], kind="stable")]
    rank = np.full(len(words) + depth + 1, -1, dtype=np.int64)
    slots, sort_key = np.arange(len(order)), key[order]
    while len(slots):
        fresh = np.append(True, sort_key[1:] != sort_key[:-1])
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(slots)))
        rank[order[slots]] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size > 1, size)]
        if span >= depth or not len(slots):
            break
        tied = order[slots]
        sort_key = rank[tied] * (len(words) + 2) + rank[np.minimum(tied + span, len(words))] + 1
        by = np.argsort(sort_key, kind="stable")
        order[slots], sort_key = tied[by], sort_key[by]
        span *= 2
    return order


def _bisect(words, order, lo, hi, depth, wanted, right):
    """For each interval the first place whose word at ``depth`` is not below (``right``: is above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        there = words[order[mid] + depth]
        below = there <= wanted[live] if right else there < wanted[live]
        lo[live[below]] = mid[below] + 1
        hi[live[~below]] = mid[~below]
        live = live[lo[live] < hi[live]]
    return lo


class Shard:
    """Suffix array of some texts over a block's vocabulary (0 for other words and between texts), with the block's suffixes searched in it."""

    def __init__(self, data, offsets, block: Block, index: KeyIndex):
        hashes, self.first = _hashed(data, offsets)
        self.size = np.diff(self.first)
        self.block = block
        self.depth = int(min(block.rest.max(initial=1), max(self.size.max(initial=1), 1)))  # no match is longer
        bits = max(1, int(len(block.vocabulary)).bit_length())
        self.span = max(1, min(63 // bits, int(block.window.min(initial=WINDOW))))
        text = np.repeat(np.arange(len(self.size)), self.size)
        self.words = np.zeros(len(hashes) + len(self.size) + self.depth + 1, dtype=np.int64)
        self.words[np.arange(len(hashes)) + text] = index.find(hashes.view(np.int64)) + 1
        key = packed_words(self.words, bits, self.span)
        self.order = suffix_array(self.words, key, self.span, self.depth)
        ranked, wanted = key[self.order], packed_words(block.words, bits, self.span)[block.starts]
        by = np.argsort(wanted, kind="stable")  # in order, so that neighbouring searches touch the same part
        lo, hi = np.empty(len(by), dtype=np.int64), np.empty(len(by), dtype=np.int64)
        lo[by], hi[by] = np.searchsorted(ranked, wanted[by], "left"), np.searchsorted(ranked, wanted[by], "right")
        self.suffix = np.flatnonzero(lo < hi)
        self._extend(lo[self.suffix], hi[self.suffix])

    def _extend(self, lo, hi):
        """Word by word: the interval of each suffix's window, and its longest match."""
        block, n = self.block, len(self.suffix)
        start, window, rest = block.starts[self.suffix], block.window[self.suffix], block.rest[self.suffix]
        self.window_lo, self.window_hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.longest, self.where = np.full(n, self.span), lo.copy()
        live, depth = np.arange(n), self.span
        while len(live):
            done = live[window[live] == depth]
            self.window_lo[done], self.window_hi[done] = lo[done], hi[done]
            self.longest[live], self.where[live] = depth, lo[live]
            live = live[rest[live] > depth]
            wanted = block.words[start[live] + depth]
            a = _bisect(self.words, self.order, lo[live], hi[live], depth, wanted, False)
            b = _bisect(self.words, self.order, a, hi[live], depth, wanted, True)
            lo[live], hi[live] = a, b
            live = live[a < b]
            depth += 1

    def _text(self, place):
        """The text in which a place of ``words`` lies."""
        return np.searchsorted(self.first[:-1] + np.arange(len(self.size)), place, side="right") - 1

    def hits(self):
        """(spans of hit words as text, first, end; pairs of text and item): windows are looked up once each, however many items hold them."""
        block, found = self.block, np.flatnonzero(self.window_lo < self.window_hi)
        item, length = block.item[self.suffix[found]], block.window[self.suffix[found]]
        lo, hi = self.window_lo[found], self.window_hi[found]
        _, once, same = np.unique(lo * (self.depth + 1) + length, return_index=True, return_inverse=True)
        size = (hi - lo)[once]
        window = np.repeat(np.arange(len(once)), size)
        place = self.order[np.arange(size.sum()) + np.repeat(lo[once] - (np.cumsum(size) - size), size)]
        edge = np.bincount(place, minlength=len(self.words) + 1)
        edge -= np.bincount(place + length[once][window], minlength=len(self.words) + 1)
        cover = np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)
        begin, end = np.flatnonzero(np.diff(cover) > 0), np.flatnonzero(np.diff(cover) < 0)
        text = self._text(begin)
        base = self.first[text] + text
        # Texts of each window, then the items of each window.
        pair = np.unique(window * (len(self.size) + 1) + self._text(place))
        window, holder = pair // (len(self.size) + 1), pair % (len(self.size) + 1)
        by = np.argsort(same, kind="stable")
        count = np.bincount(same, minlength=len(once))
        items_of = np.cumsum(count) - count
        times = count[window]
        listed = item[by][np.arange(times.sum()) + np.repeat(items_of[window] - (np.cumsum(times) - times), times)]
        pair = np.unique(np.repeat(holder, times) * len(block.names) + listed)
        return (text, begin - base, end - base), (pair // len(block.names), pair % len(block.names))

    def matches(self):
        """(item, its first word, text, its first word, words): the longest match here of each suffix that matches a window, one place of each."""
        found = np.flatnonzero(self.window_lo < self.window_hi)
        suffix = self.suffix[found]
        place = self.order[self.where[found]]
        text = self._text(place)
        item = self.block.item[suffix]
        begun, first = np.unique(self.block.item, return_index=True)  # an item's first suffix begins a window
        item_begin = np.zeros(len(self.block.names) + 1, dtype=np.int64)
        item_begin[begun] = self.block.starts[first]
        return item, self.block.starts[suffix] - item_begin[item], text, place - self.first[text] - text, self.longest[found]


_ROW = "n_words long, spans array<struct<lo: int, hi: int>>, items array<string>"


def _grouped(index, n):
    return np.concatenate([[0], np.cumsum(np.bincount(index, minlength=n))]).astype(np.int32)


def _joined(old, new, n):
    """List column ``old`` with the lists of ``new`` appended row by row."""
    if old is None:
        return new
    return pa.array([(a or []) + (b or []) for a, b in zip(old.to_pylist(), new.to_pylist())], new.type)


def _search(block, keep):
    """Rows with the words, hit spans and items of their text; the columns ``keep`` stay. Earlier blocks' spans and items are added to."""
    def run(batches):
        test = block.value
        index = KeyIndex(test.vocabulary.view(np.int64))
        for batch in batches:
            for lo, data, offsets in text_slices(batch.column("text"), SHARD_BYTES):
                n = len(offsets) - 1
                rows = batch.slice(lo, n)
                shard = Shard(data, offsets, test, index)
                (text, a, b), (holder, item) = shard.hits()
                spans = pa.ListArray.from_arrays(_grouped(text, n), pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["lo", "hi"]))
                items = pa.ListArray.from_arrays(_grouped(holder, n), pa.array([test.names[i] for i in item.tolist()], pa.string()))
                old = (rows.column("spans"), rows.column("items")) if "spans" in batch.schema.names else (None, None)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(shard.size, pa.int64()), _joined(old[0], spans, n), _joined(old[1], items, n)],
                                                 [*keep, "n_words", "spans", "items"])
    return run


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text"):
    """Broadcasts of the benchmark's blocks, one after the other: items dealt by hash into as many blocks as keep each under twice BLOCK_BYTES (or a single item)."""
    items = benchmark.select(nfc(item_col).cast("string").alias("name"), nfc(text_col).alias("text")).where("text is not null").distinct()
    key = F.xxhash64("name", "text")
    size = F.octet_length("text").cast("long")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    while n > 1:
        worst = items.groupBy(F.pmod(key, F.lit(n))).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("c")).where(f"b > {2 * BLOCK_BYTES} and c > 1")
        if worst.isEmpty():
            break
        n *= 2
    context = benchmark.sparkSession.sparkContext
    for b in range(n):
        rows = items.where(F.pmod(key, F.lit(n)) == b).toArrow()
        yield context.broadcast(make_block(rows.column("name").to_pylist(), rows.column("text").combine_chunks(), window))


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, benchmark_text: str) -> DataFrame:
    """``rows`` (text, ...) with n_words, spans and items."""
    ship_package(rows.sparkSession)
    keep, out = rows.columns, None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for block in benchmark_blocks(benchmark, window, item_col, benchmark_text):
        source = rows if out is None else staged(out, "searched")
        out = source.mapInArrow(_search(block, keep), f"{fields}, {_ROW}")
    return out


def _digest(batches):
    """Merged spans and distinct items of each row, with the digest columns."""
    for batch in batches:
        hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            total, end = 0, 0
            for s in sorted(spans, key=lambda s: s["lo"]):
                total += max(0, s["hi"] - max(end, s["lo"]))
                end = max(end, s["hi"])
            names = sorted({i for i in items if i is not None}, key=str.encode)
            hit.append(total)
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest)],
                                         ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit if it lies in an occurrence of a window: ``window`` consecutive words of an item, or all of an item
    that has fewer. Null and empty texts have no words; rows are judged one by one, so repeated rows and ids,
    null ids and ties need no rule; other columns are ignored. Items equal in id and text count once, an id with
    several texts is one item with all their windows, and windows of an item without an id hit but name no item. An empty
    benchmark hits nothing. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(nfc(id_col).cast("long").alias("doc_id"), nfc(text_col).alias("text"))
    found = _searched(rows, benchmark, window, item_col, benchmark_text).drop("text")
    out = found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """(doc_id, text, n_words, spans, items) of the affected rows: ``spans`` are ranges of words (from 0, end exclusive; those of several blocks may overlap)."""
    rows = docs.select(nfc(id_col).alias("doc_id"), nfc(text_col).alias("text"))
    return _searched(rows, benchmark, window, item_col, benchmark_text).where(F.size("spans") > 0)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                         item_col: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay as they are, whatever their names."""
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(nfc(text_col).alias("text"), *[nfc(c).alias(f"c{i}") for i, c in enumerate(rest)])
    clean = _searched(rows, benchmark, window, item_col, benchmark_text).where(F.size("spans") == 0)
    names = {text_col: "text", **{c: f"c{i}" for i, c in enumerate(rest)}}
    return clean.select(*[F.col(names[c]).alias(c) for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", benchmark_text: str = "text") -> DataFrame:
    """(item, start, words, doc_id, doc_start): the longest verbatim match in ``docs`` of every test suffix that matches a window at least.

    ``start`` and ``doc_start`` are words before the match in the item and in the document; of equally long ones the smallest id
    counts that a shard reports (a shard reports one place a suffix). Shards meet in a maximum taken before the shuffle.
    """
    ship_package(docs.sparkSession)

    def search(block):
        def run(batches):
            test = block.value
            index = KeyIndex(test.vocabulary.view(np.int64))
            for batch in batches:
                for lo, data, offsets in text_slices(batch.column("text"), SHARD_BYTES):
                    item, start, text, place, words = Shard(data, offsets, test, index).matches()
                    yield pa.RecordBatch.from_arrays([pa.array([test.names[i] for i in item.tolist()], pa.string()), pa.array(start, pa.int64()), pa.array(words, pa.int64()),
                                                      batch.slice(lo, len(offsets) - 1).column("doc_id").take(pa.array(text)), pa.array(place, pa.int64())],
                                                     ["item", "start", "words", "doc_id", "doc_start"])
        return run

    rows = docs.select(nfc(id_col).cast("long").alias("doc_id"), nfc(text_col).alias("text"))
    parts = [rows.mapInArrow(search(b), "item string, start long, words long, doc_id long, doc_start long") for b in benchmark_blocks(benchmark, window, item_col, benchmark_text)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.max(F.struct("words", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s"))).alias("m")
    return found.groupBy("item", "start").agg(best).select("item", "start", F.col("m.words").alias("words"), (-F.col("m.d")).alias("doc_id"), (-F.col("m.s")).alias("doc_start"))
