"""Token ids of whole texts in tasks, by a public byte-level BPE file read with the tokenizers library.

The vocabulary splits a text before every space that a non-space follows, so the ids
of a word with the space before it do not depend on the rest of the text. Each distinct word is
encoded once a worker, many at a time, and its ids are copied by array operations wherever it stands; a full stop or
comma after a letter at its end is a piece apart. A text in which a space touches other
white space, or that holds an added token, is encoded whole. Words are remembered by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import KeyIndex, text_slices, word_hashes

#: Words a worker remembers (some 40 bytes each) before it starts afresh, and words encoded at once.
REMEMBERED, AT_ONCE = 2_000_000, 4096
_CLOSING = (ord("."), ord(","))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class _Memory:
    """Ids of words by hash: a large index, and a small one for recent words that is merged into it now and then."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)  # -1: white space at an end of the word
        self.pool = np.zeros(0, dtype="<u4")
        self.merged = 0
        self.large = self.small = KeyIndex(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.large.find(keys).astype(np.int64)
        lost = np.flatnonzero(at < 0)
        recent = self.small.find(keys[lost])
        at[lost] = np.where(recent < 0, -1, recent + self.merged)
        return at

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        used = np.maximum(size, 0)
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(used) - used])
        self.keys, self.size, self.pool = np.concatenate([self.keys, keys]), np.concatenate([self.size, size]), np.concatenate([self.pool, ids])
        if len(self.keys) - self.merged > 20_000 + self.merged // 4:
            self.merged, self.large = len(self.keys), KeyIndex(self.keys)
        self.small = KeyIndex(self.keys[self.merged:])


class Encoder:
    """Encodes texts with the vocabulary file at ``path``; strings of added tokens in a text become their ids, as in the library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        # A token of a byte-level vocabulary is written with one character a byte.
        self.n_bytes = np.zeros(self.size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closing = np.array([self._ids([chr(c)])[0][0] for c in _CLOSING], dtype="<u4")
        self.memory = _Memory()
        self._ends: np.ndarray | None = None

    def sentence_ends(self) -> np.ndarray:
        """For each id whether a sentence may end after it: its text ends in . ! ? or a line break."""
        if self._ends is None:
            texts = self.tokenizer.decode_batch([[i] for i in range(self.size)], skip_special_tokens=False)
            self._ends = np.array([t.endswith((".", "!", "?", "\n")) for t in texts])
        return self._ends

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text in order; a null text has none."""
        for _, data, offsets in text_slices(column):
            ids, first = self._slice(data, offsets)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                yield ids[a:b]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, n_texts = data.tobytes(), len(offsets) - 1
        space = np.flatnonzero(data == 32)
        text = np.searchsorted(offsets, space, side="right") - 1
        starts = space + 1
        ends = np.minimum(np.append(space[1:], len(data)), offsets[text + 1])
        # A text's first word has no space before it.
        first_word = np.searchsorted(text, np.arange(n_texts + 1))
        head_ends = offsets[1:].copy()
        some = first_word[1:] > first_word[:-1]
        head_ends[some] = space[first_word[:-1][some]]
        closed = np.zeros(len(starts), dtype=np.int64)
        long_ = np.flatnonzero(ends - starts > 1)
        long_ = long_[_LETTER[data[ends[long_] - 2]]]
        for i, c in enumerate(_CLOSING):
            closed[long_[data[ends[long_] - 1] == c]] = i + 1
        stops = ends - (closed > 0)
        hashes, at, inverse = np.unique(word_hashes(data, starts, stops, lower=False).view(np.int64), return_index=True, return_inverse=True)
        word = self._known(hashes, raw, starts[at], stops[at])[inverse]
        size = self.memory.size[word].astype(np.int64)
        whole = np.unique(np.concatenate([text[size < 0], self._holding(raw, offsets)]))
        skipped = np.isin(text, whole)
        heads = self._ids([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), head_ends.tolist())])
        for i in whole.tolist():
            heads[i] = self._ids([raw[offsets[i]:offsets[i + 1]].decode()])[0]
        size[skipped] = closed[skipped] = 0
        # Places of heads and words in the stream of ids.
        units = np.zeros(len(starts) + n_texts, dtype=np.int64)
        head_at = first_word[:-1] + np.arange(n_texts)
        is_word = np.ones(len(units), dtype=bool)
        is_word[head_at] = False
        units[head_at] = [len(h) for h in heads]
        units[is_word] = size + (closed > 0)
        place = np.concatenate([[0], np.cumsum(units)])
        ids = np.empty(place[-1], dtype="<u4")
        for a, h in zip(place[head_at].tolist(), heads):
            ids[a:a + len(h)] = h
        begin = place[:-1][is_word]
        shift = np.cumsum(size) - size
        step = np.arange(size.sum())
        ids[step + np.repeat(begin - shift, size)] = self.memory.pool[step + np.repeat(self.memory.first[word] - shift, size)]
        for i, c in enumerate(self.closing):
            mine = closed == i + 1
            ids[begin[mine] + size[mine]] = c
        return ids, place[np.append(head_at, len(units))]

    def _holding(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """Texts in which an added token begins."""
        found = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.append(at)
                at = raw.find(token, at + 1)
        return np.searchsorted(offsets, np.array(found, dtype=np.int64), side="right") - 1

    def _known(self, hashes: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the words in the memory, after learning those it lacks."""
        if len(self.memory.keys) > REMEMBERED:
            self.memory = _Memory()
        at = self.memory.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            plain = [i for i, w in enumerate(words) if w and not w[0].isspace() and not w[-1].isspace()]
            size = np.full(len(new), -1, dtype=np.int32)
            ids = []
            for lo in range(0, len(plain), AT_ONCE):
                some = plain[lo:lo + AT_ONCE]
                found = self._ids(["".join(" " + words[i] for i in some)])[0]
                stop = np.searchsorted(np.cumsum(self.n_bytes[found]), np.cumsum([ends[new[i]] - starts[new[i]] + 1 for i in some])) + 1
                size[some] = np.diff(stop, prepend=0)
                ids.append(found)
            self.memory.add(hashes[new], size, np.concatenate(ids) if ids else self.memory.pool[:0])
            at[new] = self.memory.find(hashes[new])
        return at


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
