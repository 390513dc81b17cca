"""Vectorised word hashing for tasks that read Arrow batches of texts.

A word is a run of characters outside space and the control characters 9
to 13; with ``lower`` A-Z count as a-z. Words and shingles are carried as
64-bit hashes, so two different ones are taken for equal with probability
about 2^-64 a pair; no text is cut and none is copied word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about this many bytes, which bounds a task's memory; a longer text is a slice alone.
SLICE_BYTES = 800_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[0x41:0x5B] = _VALUE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the longest slice so far."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES * 5 // 4)
        made = []
        for b in (_BASE, _BASE_INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows holding about ``limit`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words begin in those arrays (one entry more than texts); ``space`` flags the bytes outside words."""
    n = len(data)
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(space[data], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]
    # A word also ends where its text ends.
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    joined = np.unique(inner[solid[inner] & solid[inner + 1]])
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial read off prefix sums, then mixed with the length."""
    power, inverse = _powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * power[:len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, one for the whole sequence."""
    n = len(words)
    if n >= k:
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[i:n - k + 1 + i]
        h = mix(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(h[a:b - k + 1])
        elif b > a:
            v = b - a
            for w in words[a:b].tolist():
                v = (v * 0xA0761D6478BD642F + w) % 2**64
            yield mix(np.array([v], dtype=np.uint64))
        else:
            yield words[:0]


class KeyIndex:
    """Places of distinct keys, found by open addressing on whole arrays; -1 where a key is unknown."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.append(keys, -1)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.slots[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slots[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out
