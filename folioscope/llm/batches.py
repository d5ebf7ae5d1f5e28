"""Batches of texts as arrays: the distinct stretches between white space, and the words inside them.

What is said of a word is worked out once for each distinct stretch of a batch and gathered for its
places.  Nothing is kept from one batch to the next, so memory follows the batch, not the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


@dataclass
class Stretches:
    """distinct: each stretch once; codes: which one stands at each place, text after text; sizes: places of each text."""

    distinct: list
    codes: np.ndarray
    sizes: np.ndarray

    def text_sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of ``values`` (a row for each distinct stretch) over its places."""
        out = np.zeros((len(self.sizes), values.shape[1]))
        some = np.nonzero(self.sizes)[0]
        if len(some):
            starts = (np.cumsum(self.sizes) - self.sizes)[some]
            for k in range(values.shape[1]):
                out[some, k] = np.add.reduceat(values[:, k].astype(np.float64)[self.codes], starts)
        return out


def stretches(texts: pa.Array, ascii: bool = False) -> Stretches:
    """Stretches of every text; a null text has none.  With ``ascii``, A-Z is lowered and only ASCII white space divides."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts)) if ascii else pc.utf8_split_whitespace(texts)
    bounds = parts.offsets.to_numpy()
    coded = parts.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    # White space at either end of a text leaves an empty part.
    blank = pc.index(coded.dictionary, "").as_py()
    if blank < 0:
        return Stretches(distinct, codes, np.diff(bounds).astype(np.int64))
    del distinct[blank]
    real = codes != blank
    sizes = np.diff(np.append(0, np.cumsum(real))[bounds - bounds[0]])
    codes = codes[real]
    return Stretches(distinct, codes - (codes > blank), sizes)


@functools.cache
def char_table(test: Callable[[str], bool]) -> np.ndarray:
    """Whether ``test`` holds of each code point."""
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """Runs of characters of one kind inside stretches: chars (code points of all stretches), and start, end and stretch of each word."""

    joined: str
    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    n_stretches: int

    def strings(self) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]

    def counts(self) -> np.ndarray:
        """Words of each stretch."""
        return np.bincount(self.owner, minlength=self.n_stretches)

    def per_stretch(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` (a row for each word) by stretch."""
        out = np.zeros((self.n_stretches, values.shape[1]), values.dtype)
        if len(values):
            first = np.nonzero(np.append(True, self.owner[1:] != self.owner[:-1]))[0]
            out[self.owner[first]] = np.add.reduceat(values, first, axis=0)
        return out


def words(distinct: list[str], test: Callable[[str], bool], lower: bool = True) -> Words:
    """The longest runs of characters of which ``test`` (``str.isalpha``, ``str.isalnum``) holds."""
    joined = "\n".join(distinct)
    joined = joined.lower() if lower else joined
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    inside = np.concatenate([[False], char_table(test)[chars], [False]])
    start = np.nonzero(inside[1:-1] & ~inside[:-2])[0]
    end = np.nonzero(inside[1:-1] & ~inside[2:])[0] + 1
    owner = np.cumsum(chars == 10)[start] if len(chars) else np.zeros(0, np.int64)
    return Words(joined, chars, start, end, owner, len(distinct))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then those of first[1], and so on."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


class Lookup:
    """Rows of 64-bit keys by open addressing, for arrays of keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self._mask = np.uint64(size - 1)
        self._slots = np.full(size, -1, np.int32)
        rows, at = np.arange(len(keys), dtype=np.int32), (keys & self._mask).astype(np.int64)
        self._probes = 0
        while len(rows):
            self._probes += 1
            free = self._slots[at] < 0
            self._slots[at[free]] = rows[free]  # of several for one slot, one stays
            rest = self._slots[at] != rows
            rows, at = rows[rest], (at[rest] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        todo, at = np.arange(len(keys)), (keys & self._mask).astype(np.int64)
        for _ in range(self._probes):
            rows = self._slots[at]
            hit = (rows >= 0) & (self.keys[rows] == keys[todo])
            out[todo[hit]] = rows[hit]
            more = (rows >= 0) & ~hit
            if not more.any():
                break
            todo, at = todo[more], (at[more] + 1) & (len(self._slots) - 1)
        return out


def word_keys(w: Words) -> np.ndarray:
    """A 64-bit key for each word, from its characters and their places."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    x = w.chars[ranges(w.start, size)].astype(np.uint64)
    place = ranges(np.ones(len(size), np.int64), size).astype(np.uint64)
    h = mix((x + (place << np.uint64(32))) * P1)
    return mix(np.add.reduceat(h, np.cumsum(size) - size) + size.astype(np.uint64))
