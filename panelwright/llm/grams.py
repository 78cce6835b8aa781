"""Words and hashes of word runs for whole batches of texts, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least(h: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n values in a row."""
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minima(h: np.ndarray, ok: np.ndarray, n: int) -> np.ndarray:
    """Whether each value is the smallest of some n values in a row; ``ok`` says which rows, by their first value, count.

    Equal smallest values are all marked.
    """
    k = len(h) - n + 1
    if k < 1:
        return np.zeros(len(h), bool)
    most = np.zeros(k + 2 * (n - 1), np.uint64)
    most[n - 1 : n - 1 + k] = np.where(ok[:k], least(h, n), np.uint64(0))
    # the largest of the minima of all rows that a value is in; no value is below it but in rows that do not count
    return (h == ~least(~most, n)) & (np.convolve(np.r_[ok[:k], np.zeros(n - 1, bool)], np.ones(n, bool))[: len(h)] > 0)


class Grams:
    """Words of texts in order; ``doc`` numbers the text of each word."""

    def __init__(self, words: list[list[bytes]]):
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.doc = np.repeat(np.arange(len(words)), self.counts)
        self.joined = joined = b" ".join(w for own in words for w in own)
        lens = np.fromiter((len(w) for own in words for w in own), np.int64, len(self.doc))
        self.end = np.cumsum(lens) + np.arange(len(lens))
        self.start = self.end - lens
        buf = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(buf * powers(_BASE, len(buf)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(buf) + 1)

    def hashes(self, n: int) -> np.ndarray:
        """Of the n words from each word on, whether in one text or not; shorter than the words by n - 1."""
        k = max(0, len(self.doc) - n + 1)
        s, e = self.start[:k], self.end[n - 1 : n - 1 + k]
        return mixed((self.sums[e] - self.sums[s]) * self.back[s], n)

    def whole(self, n: int) -> np.ndarray:
        """Whether the n words from each word on are of one text."""
        k = max(0, len(self.doc) - n + 1)
        return self.doc[:k] == self.doc[n - 1 : n - 1 + k]


def word_pieces(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time, so that a very long text needs no list of all."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            m = SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].split()
        at = end


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[slice, list]]:
    """Slices of a batch with about ``most`` bytes of a column each, one value at least, and the column's values there.

    Only one slice at a time is made into Python objects.
    """
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield slice(start, i), values.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes)), values.slice(start).to_pylist()
