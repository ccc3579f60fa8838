"""Elias-Fano sequences over numpy arrays, with vectorised access and search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_ONE = U64(1)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, in 64-bit words (one spare word at the end)."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 1, dtype=U64)
    if not width or not n:
        return words
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(words, word, values << shift)
    over = (at & 63) + width > 64
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return words


def unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), dtype=U64)
    at = i.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return (low | high) & U64((1 << width) - 1)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit of this rank in each word."""
    at = np.zeros(len(word), dtype=U64)
    rank = rank.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count((word >> at) & U64((1 << step) - 1)).astype(np.int64)
        go = rank >= count
        rank = rank - count * go
        at += U64(step) * go.astype(U64)
    return at.astype(np.int64)


@dataclass
class EliasFano:
    """A non-decreasing sequence of unsigned integers.

    ``low``: the low bits, packed; ``high``: for each value v at i, bit (v >> width) + i is
    set; ``ones``: how many bits are set before each word of ``high``; ``zeros`` likewise.
    """

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        upper = (values >> U64(width)).astype(np.int64)
        at = upper + np.arange(n)
        size = (int(at[-1]) if n else 0) // 64 + 2
        flags = np.zeros(size * 64, dtype=np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
        zeros = np.arange(size, dtype=np.int64) * 64 - ones
        kind = np.uint32 if size * 64 < 1 << 32 else np.uint64
        return cls(n, width, pack(values & U64((1 << width) - 1), width), high, ones.astype(kind), zeros.astype(kind))

    def _select(self, directory: np.ndarray, flip: bool, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(directory, rank.astype(directory.dtype), side="right") - 1
        bits = self.high[word]
        return word * 64 + _select_in_word(~bits if flip else bits, rank - directory[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        i = i.astype(np.int64)
        upper = (self._select(self.ones, False, i) - i).astype(U64)
        return (upper << U64(self.width)) | unpack(self.low, self.width, i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """First place of each value, -1 where it isn't there: its upper half leads to a run, searched by its lower half."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        upper = (x >> U64(self.width)).astype(np.int64)
        last = len(self.high) * 64 - self.n - 1
        ask = np.flatnonzero((upper >= 0) & (upper <= last))
        upper = upper[ask]
        start = np.zeros(len(ask), dtype=np.int64)
        some = np.flatnonzero(upper > 0)
        start[some] = self._select(self.zeros, True, upper[some] - 1) - (upper[some] - 1)
        end = self._select(self.zeros, True, upper) - upper
        want = x[ask] & U64((1 << self.width) - 1)
        lo, hi = start.copy(), end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = unpack(self.low, self.width, mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < end)
        inside = inside[unpack(self.low, self.width, lo[inside]) == want[inside]]
        out[ask[inside]] = lo[inside]
        return out

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]
