"""Token ids of texts by a public word-level BPE tokenizer, computed once per distinct unit of a worker."""

from __future__ import annotations

import os

import numpy as np

from acadspark.llm.common import lowered, prefix_hash, span_hash

SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
CACHE_UNITS = 300_000
LEARNED = 2000
_ENCODERS: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that the tokenizer treats on their own: no white space inside, and parted between an ASCII letter and ASCII
    punctuation other than the apostrophe. No letter run, contraction or punctuation run is ever cut."""
    space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
    letter = (data >= 97) & (data <= 122)
    mark = (data > 32) & (data < 127) & ~letter & (data != 39) & ~((data >= 48) & (data <= 57))
    first = ~space
    cut = np.zeros(len(data), bool)
    cut[1:] = space[:-1] | (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    at = offsets[:-1]
    cut[at[at < len(data)]] = True
    starts = np.flatnonzero(first & cut)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:-1] = first[:-1] & (space[1:] | cut[1:])
    if len(data):
        stops[-1] = first[-1]
    return starts, np.flatnonzero(stops)


class Encoder:
    """Ids of many texts at once. Equal units are encoded once; the memory is emptied at CACHE_UNITS units."""

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special  # True: their strings are ordinary text
        self.special = special
        self.clear()

    @classmethod
    def shared(cls, path: str, special: bool = True) -> Encoder:
        """The encoder of this Python worker; what it knows serves all its tasks."""
        if (path, special) not in _ENCODERS:
            _ENCODERS[path, special] = cls(path, special)
        return _ENCODERS[path, special]

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.sizes, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _learn(self, hashes: list[int], units: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        new = np.array([i for x in ids for i in x], np.uint32)
        n = len(self.known)
        while n + len(ids) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts] * 2), np.concatenate([self.sizes] * 2)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.sizes[n: n + len(ids)] = sizes
        self.starts[n: n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used: self.used + len(new)] = new
        self.used += len(new)
        self.known.update(zip(hashes, range(n, n + len(ids)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them); ``offsets`` starts at 0 of ``data``."""
        if self.special:
            raw = data.tobytes()
            if any(s in raw for s in SPECIAL):
                return self._whole(raw, offsets)
        if len(self.known) > CACHE_UNITS:
            self.clear()
        low = lowered(data)
        start, end = unit_bounds(low, offsets)
        unit, first, back = np.unique(span_hash(prefix_hash(low), start, end), return_index=True, return_inverse=True)
        unit = unit.tolist()
        index = np.fromiter((self.known.get(u, -1) for u in unit), np.int64, len(unit))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            n = len(self.known)
            raw = low.tobytes()
            for i in range(0, len(missing), LEARNED):
                part = missing[i: i + LEARNED]
                self._learn([unit[k] for k in part], [raw[start[k]: end[k]].decode() for k in first[part]])
            index[missing] = np.arange(n, n + len(missing))
        index = index[back]
        size = self.sizes[index]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.starts[index] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
