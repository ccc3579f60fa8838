"""Vectorised word scanning of Arrow string columns.

A batch's UTF-8 bytes are classified through a 256-entry table, word borders are
found by comparing neighbours, and every word gets a 64-bit hash from one
wrapping prefix sum: with an odd base P, ``sum(b[i] * P**i)`` over a word times
``P**-start`` depends on the word alone.  Every non-ASCII code point consists of
bytes >= 0x80 only, so classes that treat all of those alike can be tested
bytewise.

Null texts scan as empty.  Words never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII letters and digits, and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Everything but the space and U+0009 to U+000D.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = False
NONSPACE[9:14] = False

#: Bytes that are hashed at once; the powers held by a worker cover as many and no more.
PIECE = 1 << 18
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, and their inverses; only those of one piece are held."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(max(n, PIECE + 1024), base, dtype=U64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    if not _powers and n <= PIECE + 1024:
        _powers.extend(out)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Scan:
    """Words of some rows: byte ranges into ``data``, row numbers, hashes, and the words' bounds by row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _border(raw: np.ndarray, chars: np.ndarray, at: int, offsets: np.ndarray) -> int:
    """The first place from ``at`` on where no word goes on: the end, a row's border, or a byte of no word."""
    row_end = int(offsets[np.searchsorted(offsets, at)])
    while at < row_end:
        outside = np.flatnonzero(~chars[raw[at : min(at + 4096, row_end)]])
        if len(outside):
            return at + int(outside[0])
        at = min(at + 4096, row_end)
    return row_end


def scan(texts: pa.Array, chars: np.ndarray = ALNUM) -> Scan:
    """All words of the rows, A-Z lower-cased; ``chars`` says which bytes belong to words.

    The bytes are hashed in pieces that end where no word goes on, so beside the text itself
    memory goes to its words (some 25 bytes each), however long a text is.
    """
    raw, offsets = string_buffers(texts)
    n = len(raw)
    data = LOWER[raw]
    starts, ends, hashes, at = [], [], [], 0
    while at < n:
        to = _border(raw, chars, at + PIECE, offsets) if at + PIECE < n else n
        inside = chars[raw[at:to]]
        edge = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        before = np.zeros(to - at + 1, dtype=bool)
        before[1:] = inside
        before[edge] = False
        start = np.flatnonzero(inside & ~before[:-1])
        before[:-2] = inside[1:]
        before[-2:] = False
        before[edge[edge > 0] - 1] = False
        end = np.flatnonzero(inside & ~before[:-1]) + 1
        power, inverse = _powers_to(to - at + 1)
        total = np.empty(to - at + 1, dtype=U64)
        total[0] = 0
        np.add(data[at:to], U64(1), out=total[1:], dtype=U64)
        total[1:] *= power[: to - at]
        np.cumsum(total, out=total)
        hashes.append(mix((total[end] - total[start]) * inverse[start]))
        starts.append(start + at)
        ends.append(end + at)
        at = to
    start, end, value = (np.concatenate(x) if x else np.zeros(0, dtype=kind) for x, kind in ((starts, np.int64), (ends, np.int64), (hashes, U64)))
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Scan(data, start, end, row, value, bounds)


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` bytes each; a longer text stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, to
        at = to


_STEPS = [U64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(s: Scan, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of each row's *set* of runs of ``size`` words, sorted within a row.

    A row with fewer words, but at least one, has the run of all its words; a row without words has none.
    """
    h, n = s.hash, len(s.hash)
    if n >= size:
        whole = s.row[: n - size + 1] == s.row[size - 1 :]
        at = np.flatnonzero(whole)
        value = np.zeros(len(at), dtype=U64)
        for k in range(size):
            value = (value + h[at + k]) * _STEPS[k % len(_STEPS)]
            value ^= value >> U64(29)
        rows = s.row[at]
    else:
        value, rows = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    count = np.diff(s.bounds)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        extra = np.zeros(len(few), dtype=U64)
        for j, r in enumerate(few):
            v = 0x51ED270B
            for x in h[s.bounds[r] : s.bounds[r + 1]].tolist():
                v = ((v ^ x) * _BASE + 1) & 0xFFFFFFFFFFFFFFFF
            extra[j] = v
        value, rows = np.concatenate([value, extra]), np.concatenate([rows, few])
    value = mix(value)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    if len(value):
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
        value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(s.rows + 1))


def by_row(function, values: np.ndarray, bounds: np.ndarray, empty):
    """``function.reduceat`` over each row's values, ``empty`` for rows without any."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = function.reduceat(values, bounds[full])
    return out
