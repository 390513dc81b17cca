"""Content-chosen anchors that deal byte strings into groups.

Of the ``K``-byte grams of a string of ``n`` bytes the one with the least hash is its
anchor (the leftmost of equals). Equal strings have equal anchors, wherever they stand, so
strings need comparing only within the group of their anchor.
"""

from __future__ import annotations

import numpy as np

from .words import mix

K = 32
_BYTE = np.random.default_rng(7777).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the K bytes from every position, by doubling; K - 1 entries shorter than ``data``."""
    h = _BYTE[data]
    span = 1
    for f in _FACTORS:
        h = h[:-span] * f + h[span:]
        span *= 2
    return mix(h)


def prefix_sums(data: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * power[:len(data)], out=out[1:])
    return out


def anchor_runs(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive n-byte windows with one anchor: (text, first window, windows, anchor's place, anchor's hash); places count from the slice's start."""
    if len(data) < n:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=np.uint64),)
    h = gram_hashes(data)
    m = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, span = n - K + 1, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[:span - width], m[width - span:])
    place = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that stay inside their text.
    lengths = np.diff(offsets)
    inside = np.zeros(len(place) + 1, dtype=np.int8)
    ok = lengths >= n
    np.add.at(inside, offsets[:-1][ok], 1)
    stop = offsets[1:][ok] - n + 1
    np.add.at(inside, stop, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    fresh = np.empty(len(place), dtype=bool)
    fresh[0] = True
    np.not_equal(place[1:], place[:-1], out=fresh[1:])
    fresh[offsets[:-1][ok]] = True
    fresh &= inside
    at = np.flatnonzero(fresh)
    # A run ends before the next one, or where its text's windows end.
    text = np.searchsorted(offsets, at, side="right") - 1
    last = offsets[text + 1] - n + 1
    end = np.minimum(np.append(at[1:], len(place)), last)
    return text, at, end - at, place[at], h[place[at]]
