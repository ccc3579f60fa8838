"""Benchmark decontamination by spaced seeds.

Fixed masks pick words out of a span and ignore the others, so a seed survives substitutions
at ignored positions.  The seeds of the benchmark are hashed into a sorted index; every
position of every document is hashed under every mask and joined with it.  Around a hit,
document and item are aligned along the hit's diagonal.  They overlap if some segment there
holds LEAST_WORDS equal words, or SHARE of a shorter item's, and SHARE of the segment's words
are equal; reported is the segment with the most equal words.

Items of WHOLE words and more are sought under MASKS wherever these fit: any 13 equal words
of 16 contain one of them, and of 16 of 20 all but one placement in a thousand.  Shorter
items may differ from the document in a fifth of their words, rounded down; they are cut into
blocks, and there is a mask for each choice of as many blocks to ignore, so every overlap of
theirs is found, also at a document's edge.  Items of one to four words are found unchanged.

The benchmark, without its repeated rows, is taken in blocks of about BLOCK_BYTES of text,
each against all documents; a block's index is some ten times its text, and that is what is
broadcast, however many items there are.  Hits on one diagonal of repeated words are
recognised before they are paired, so long runs of one word cost their lengths' sum.

Defined results: null or empty texts, in documents or benchmark, match nothing; repeated
documents each get their own results, repeated items one; an item with a null id has item_id
-1; an empty table of either kind matches nothing.  :func:`clean` keeps a document whose
overlaps have fewer than REJECTED equal words, and all columns, whatever their names;
:func:`overlaps` reads doc_id and text alone.  Long texts are scanned in pieces; a worker holds
a text and some 25 bytes for each of its words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textscan import U64, Scan, mix, scan, slices

#: Positions that a mask looks at (fixed values).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 5, 6), (0, 1, 2, 8, 10, 11))
#: LEAST_WORDS equal words make an overlap; segments hold SHARE (4 of 5) of equal words.
LEAST_WORDS, SHARE = 13, (4, 5)
WHOLE, REJECTED = 13, 5
#: Bytes of benchmark text in one block, pairs of hits expanded at once.
BLOCK_BYTES, PAIRS = 1 << 21, 1 << 20
_TABLE_BITS = 22
_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def needed(words: int) -> int:
    """How many equal words make an overlap with an item of so many."""
    return min(LEAST_WORDS, -(-SHARE[0] * words // SHARE[1]))


def whole_masks(words: int) -> list[tuple[int, ...]]:
    """Masks over an item of so many words of which any overlap with it contains one."""
    off = words - needed(words)
    blocks = np.array_split(np.arange(words), off + 2) if off else [np.arange(words)]
    return [tuple(int(i) for k, b in enumerate(blocks) if k not in ignored for i in b) for ignored in itertools.combinations(range(len(blocks)), off)]


def seeds(h: np.ndarray, row: np.ndarray, offsets: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions of the first word looked at) of one mask wherever it lies within a row."""
    span = offsets[-1] - offsets[0] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    value = np.full(n, salt, dtype=U64)
    for k, o in enumerate(offsets):
        value += h[o - offsets[0] : o - offsets[0] + n] * (_ODD[k % len(_ODD)] + U64(2 * (k // len(_ODD))))
    at = np.flatnonzero(row[:n] == row[span - 1 :])
    return mix(value[at]), at


def continued(value: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the position before, of the same owner, has the same seed."""
    out = np.zeros(len(value), dtype=bool)
    out[1:] = (value[1:] == value[:-1]) & (at[1:] == at[:-1] + 1) & (owner[1:] == owner[:-1])
    return out


@dataclass
class Hit:
    row: int
    item_id: int
    doc_start: int
    item_start: int
    n_words: int
    n_same: int


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        s = scan(pa.array([t for _, t in items], pa.string()))
        self.hash, self.bounds = s.hash, s.bounds
        length = np.diff(s.bounds)
        self.masks = [(offsets, salt) for salt, offsets in enumerate(MASKS)] if (length >= WHOLE).any() else []
        for n in range(1, WHOLE):
            if (length == n).any():
                self.masks += [(offsets, 100 * n + k) for k, offsets in enumerate(whole_masks(n))]
        found = []
        for offsets, salt in self.masks:
            value, at = seeds(s.hash, s.row, offsets, salt)
            own = s.row[at]
            n = salt // 100
            fits = (length[own] == n) & (at - s.bounds[own] == offsets[0]) if n else length[own] >= WHOLE
            value, at, own = value[fits], at[fits], own[fits]
            found.append((value, at, own, continued(value, at, own)))
        if not found:
            found = [(np.zeros(0, dtype=U64), *(np.zeros(0, dtype=np.int64),) * 2, np.zeros(0, dtype=bool))]
        value, at, own, again = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((again, value))
        self.value, self.item = value[order], own[order].astype(np.int32)
        self.at = (at[order] - s.bounds[own[order]]).astype(np.int32)
        #: How many of the entries up to each don't continue the one before; within a value they come first.
        self.first = np.concatenate([[0], np.cumsum(~again[order])])
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.value >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def diagonals(self, s: Scan) -> np.ndarray:
        """The different (row, item, diagonal) on which seeds meet."""
        out = [np.zeros((0, 3), dtype=np.int64)]
        for offsets, salt in self.masks:
            value, at = seeds(s.hash, s.row, offsets, salt)
            again = continued(value, at, s.row[at])
            maybe = np.flatnonzero(self.table[(value >> U64(64 - _TABLE_BITS)).astype(np.int64)])
            value, at, again = value[maybe], at[maybe], again[maybe]
            left, right = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
            n = np.where(again, self.first[right] - self.first[left], right - left)
            some = np.flatnonzero(n)
            at, left, n, upto = at[some], left[some], n[some], np.cumsum(n[some])
            shift = offsets[0] if salt < 100 else 0
            low = 0
            while low < len(at):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
                k = n[low:high]
                entry = np.repeat(left[low:high] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
                place = np.repeat(at[low:high], k)
                own = s.row[place]
                found = np.stack([own, self.item[entry], place - s.bounds[own] - self.at[entry] - shift], axis=1)
                out.append(_distinct(found))
                low = high
        return _distinct(np.concatenate(out))

    def find(self, s: Scan) -> list[Hit]:
        """The best verified overlap of each row and item."""
        best: dict[tuple[int, int], Hit] = {}
        for r, i, d in self.diagonals(s).tolist():
            hit = self._verify(s, r, i, d)
            if hit and ((r, i) not in best or hit.n_same > best[r, i].n_same):
                best[r, i] = hit
        return list(best.values())

    def _verify(self, s: Scan, r: int, i: int, d: int) -> Hit | None:
        """The segment of the diagonal with the most equal words among those with SHARE of them, if they are enough."""
        doc, item = s.hash[s.bounds[r] : s.bounds[r + 1]], self.hash[self.bounds[i] : self.bounds[i + 1]]
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        same = doc[lo + d : hi + d] == item[lo:hi]
        equal = np.concatenate([[0], np.cumsum(same)])
        need = needed(len(item))
        if equal[-1] < need:
            return None
        slack = np.concatenate([[0], np.cumsum(np.where(same, SHARE[1] - SHARE[0], -SHARE[0]))])
        later = np.maximum.accumulate(slack[::-1])[::-1]
        start = np.flatnonzero(same)
        end = np.searchsorted(-later, -slack[start], "right") - 1
        n = equal[end] - equal[start]
        k = int(np.argmax(n))
        if n[k] < need:
            return None
        a, b = int(start[k]), int(np.flatnonzero(same[: end[k]])[-1]) + 1
        return Hit(r, self.ids[i], lo + d + a, lo + a, b - a, int(n[k]))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The different rows, in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over disjoint blocks of the benchmark, about BLOCK_BYTES of text each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-total // BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index(sorted((r.item_id, r.text) for r in part.collect()))


OVERLAPS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_same long"


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps, the best of each document row and item."""
    spark = documents.sparkSession
    out = None
    names = [c.split()[0] for c in OVERLAPS.split(", ")]
    for index in blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for a, b in slices(texts):
                    hits = shared.value.find(scan(texts.slice(a, b - a)))
                    if hits:
                        rows = [[ids[a + h.row].as_py(), h.item_id, h.doc_start, h.item_start, h.n_words, h.n_same] for h in hits]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        part = small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OVERLAPS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], OVERLAPS) if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``documents``, all their columns, that share no REJECTED words or more with a benchmark item."""
    for index in blocks(benchmark):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        place = documents.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(place)
                for a, b in slices(texts):
                    keep = np.ones(b - a, dtype=bool)
                    keep[[h.row for h in shared.value.find(scan(texts.slice(a, b - a))) if h.n_same >= REJECTED]] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))

        documents = small_batches(documents).mapInArrow(run, documents.schema)
    return documents
