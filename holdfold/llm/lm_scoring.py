"""Language-model scoring with an Elias-Fano n-gram trie of order three.

Counting: tasks count the words, pairs and triples of what they read and emit, per shard,
one compressed block of sorted arrays; a shard's blocks are merged in one task, which
writes its part of the trie as one file in the shared folder.  The number of shards grows
with the corpus.  Shards are ranges of hashes, of words and of pairs, so the triples of a
frequent word spread over all of them: what one task has of a pair is one row per different
successor.  Nothing is pruned.

A shard's file has three levels.  Level 1: the sorted 64-bit hashes of its words and their
counts (as a running sum).  Level 2: the sorted 64-bit hashes of its pairs, their counts, and
pointers to their successors.  Level 3: successors, each a 32-bit hash relative to its pair's
rank, which makes the whole level one monotone sequence, and each one's count in 4 bits, those
of MANY and more in a list beside them.  All monotone sequences are Elias-Fano coded.  Scoring
maps the files into memory; a triple is found by its pair's rank, its pointers, and a search
for the successor among what the pair has.  Files hold counts alone, so the discount can be
that of all shards, known after the last one.

Model, for a word w after u, v: the triples by absolute discounting, P(w|u,v) =
max(n(u,v,w) - D, 0) / n(u,v) + D * (different successors of u,v) / n(u,v) * P(w|v), or P(w|v)
where u, v never stood; D = n1 / (n1 + 2 n2) from all training triples (0.5 without triples of
count 1 or 2).  The pairs by a prior of weight PRIOR on the base model, P(w|v) = (n(v,w) + PRIOR
* U(w)) / (n(v) + PRIOR), U(w) = (n(w) + 1) / (N + V + 1); this needs no number of successors of
single words, which lie in different shards.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; after them comes one end token;
before the first word stand two start marks, which aren't counted.  Defined results: a null
or empty text is its end token alone; a null doc_id isn't held out; repeated rows each count
and each get a row; an empty training set gives base scores 0; an empty table gives an
empty result; further columns, whatever their names, are ignored.  A worker holds some 60
bytes for each token of the texts it has at once, and those are FLUSH tokens and one text at most.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import tempfile
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, pack, unpack
from .scratch import Scratch, small_batches
from .textscan import NONSPACE, U64, mix, scan, slices

#: Hashes of the end token and of the start mark (fixed values; words hash to other values but for chance).
END, START = U64(0xE4D0F7E0A1B2C3D5), U64(0x57A27C0D1E2F3A4B)
FP_BITS = 32
FP_SHIFT = U64(64 - FP_BITS)
#: Tokens a task counts at once, bytes of text for which there is one shard.
FLUSH, SHARD_BYTES = 1_500_000, 1 << 25
#: Triple counts from here on are listed apart.
MANY, COUNT_BITS = 15, 4
PRIOR = 64.0


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7, F.lit(-1))


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U64(0x9E3779B97F4A7C15) + (w ^ U64(0xC2B2AE3D27D4EB4F)))


START_PAIR = pair_hash(np.array([START]), np.array([START]))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of the rows' tokens."""
    s = scan(texts, NONSPACE)
    bounds = np.concatenate([[0], np.cumsum(np.diff(s.bounds) + 1)])
    h = np.empty(bounds[-1], dtype=U64)
    last = np.zeros(bounds[-1], dtype=bool)
    last[bounds[1:] - 1] = True
    h[~last], h[last] = s.hash, END
    return h, bounds


def pairs_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different pairs' hashes, the pair that ends with each token, the pair before each token) of texts whose first tokens stand at ``first``."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first] = START
    pairs, place = np.unique(np.concatenate([pair_hash(before, h), START_PAIR]), return_inverse=True)
    context = np.empty(len(h), dtype=np.int64)
    context[1:] = place[:-2]
    context[first] = place[-1]
    return pairs, place[:-1], context


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so that sorted hashes fall into runs."""
    return (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


#: Kinds of a block's arrays: words and their counts; pairs (as differences), their counts and numbers of successors; successors and their counts.
_KINDS = (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)


def _block(arrays: list[np.ndarray]) -> bytes:
    """The arrays, byte by byte of their items, so that bytes that are mostly zero lie together."""
    planes = [np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(len(a), np.dtype(kind).itemsize).T for a, kind in zip(arrays, _KINDS, strict=True)]
    raw = b"".join([struct.pack(f"<{len(arrays)}Q", *(len(a) for a in arrays)), *(p.tobytes() for p in planes)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _arrays(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = struct.unpack_from(f"<{len(_KINDS)}Q", raw)
    at, out = 8 * len(_KINDS), []
    for n, kind in zip(sizes, _KINDS, strict=True):
        width = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind) if n else np.zeros(0, dtype=kind))
        at += n * width
    return out


def count_blocks(h: np.ndarray, first: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, block) of texts whose first tokens stand at ``first``."""
    words, count = np.unique(h, return_counts=True)
    pairs, place, context = pairs_of(h, first)
    times = np.bincount(place, minlength=len(pairs))
    times[np.searchsorted(pairs, START_PAIR[0])] += len(first)
    triple = (context.astype(U64) << U64(FP_BITS)) | (h >> FP_SHIFT)
    del place, context
    triple.sort()
    new = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]]))
    n = np.diff(np.concatenate([new, [len(triple)]]))
    triple = triple[new]
    bounds = np.searchsorted(triple, np.arange(len(pairs) + 1).astype(U64) << U64(FP_BITS))
    word_edges = np.searchsorted(shard_of(words, shards), np.arange(shards + 1))
    pair_edges = np.searchsorted(shard_of(pairs, shards), np.arange(shards + 1))
    for k in range(shards):
        (a, b), (c, d) = word_edges[k : k + 2], pair_edges[k : k + 2]
        if a < b or c < d:
            p, q = bounds[c], bounds[d]
            steps = np.diff(pairs[c:d], prepend=U64(0))
            yield k, _block([words[a:b], count[a:b], steps, times[c:d], np.diff(bounds[c : d + 1]), triple[p:q] & U64((1 << FP_BITS) - 1), n[p:q]])


def merge_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """Words, their counts, pairs, their counts, triples (pair's rank and successor) and theirs, all sorted."""
    parts = [_arrays(b) for b in blocks]
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
    own = [np.cumsum(p[2], dtype=U64) for p in parts]
    pairs, place = np.unique(np.concatenate(own), return_inverse=True)
    times = np.bincount(place, np.concatenate([p[3] for p in parts]), len(pairs)).astype(np.int64)
    keys, at = [], 0
    for p in parts:
        rank = place[at : at + len(p[2])].astype(U64)
        at += len(p[2])
        keys.append((np.repeat(rank, p[4]) << U64(FP_BITS)) | p[5])
    key, number = np.concatenate(keys), np.concatenate([p[6] for p in parts]).astype(np.int64)
    del keys, parts, own, place
    order = np.argsort(key, kind="stable")
    key, number = key[order], number[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return [words, count, pairs, times, key[new], np.add.reduceat(number, new) if len(new) else number]


_SEQUENCES = ("words", "counts", "pairs", "times", "pointers", "successors")


def trie_bytes(words: np.ndarray, count: np.ndarray, pairs: np.ndarray, times: np.ndarray, key: np.ndarray, number: np.ndarray) -> bytes:
    """A shard's file."""
    pointers = np.searchsorted(key, np.arange(len(pairs) + 1).astype(U64) << U64(FP_BITS))
    many = np.flatnonzero(number >= MANY)
    sequences = [EliasFano.build(x) for x in (words, np.cumsum(count), pairs, np.cumsum(times), pointers, key)]
    arrays = [a for s in sequences for a in s.parts()] + [pack(np.minimum(number, MANY).astype(U64), COUNT_BITS), many, number[many]]
    head = {"n": [s.n for s in sequences], "width": [s.width for s in sequences], "arrays": []}
    at, body = 0, []
    for a in arrays:
        head["arrays"].append([str(a.dtype), len(a), at])
        raw = a.tobytes()
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([struct.pack("<Q", len(text)), text, *body])


def _steps(sums: EliasFano, rank: np.ndarray) -> np.ndarray:
    """What running sums add at these places."""
    upto = sums.get(rank).astype(np.int64)
    before = np.zeros(len(rank), dtype=np.int64)
    some = np.flatnonzero(rank > 0)
    before[some] = sums.get(rank[some] - 1).astype(np.int64)
    return upto - before


class Shard:
    """A shard's file, mapped into memory."""

    def __init__(self, data: np.ndarray):
        size = int(data[:8].view(np.uint64)[0])
        head = json.loads(data[8 : 8 + size].tobytes())
        base = 8 + size
        arrays = [data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for kind, n, at in head["arrays"]]
        for k, name in enumerate(_SEQUENCES):
            setattr(self, name, EliasFano(head["n"][k], head["width"][k], *arrays[4 * k : 4 * k + 4]))
        self.number, self.many, self.large = arrays[-3:]

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        rank, out = self.words.find(words), np.zeros(len(words), dtype=np.int64)
        known = np.flatnonzero(rank >= 0)
        out[known] = _steps(self.counts, rank[known])
        return out

    def pair_counts(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, first successor, end of successors) of pairs; zeros for others."""
        rank = self.pairs.find(pairs)
        times, first, end, known = *(np.zeros(len(pairs), dtype=np.int64) for _ in range(3)), np.flatnonzero(rank >= 0)
        times[known] = _steps(self.times, rank[known])
        first[known], end[known] = (self.pointers.get(rank[known] + k).astype(np.int64) for k in (0, 1))
        return times, first, end

    def triple_counts(self, pairs: np.ndarray, first: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of words after pairs that have successors, found among those from ``first`` to ``end``."""
        rank = self.successors.get(first) >> U64(FP_BITS)
        at = self.successors.find((rank << U64(FP_BITS)) | (words >> FP_SHIFT))
        out = np.zeros(len(pairs), dtype=np.int64)
        hit = np.flatnonzero((at >= first) & (at < end))
        number = unpack(self.number, COUNT_BITS, at[hit]).astype(np.int64)
        large = np.flatnonzero(number == MANY)
        number[large] = self.large[np.searchsorted(self.many, at[hit[large]])]
        out[hit] = number
        return out


@functools.lru_cache(maxsize=4096)
def open_shard(folder: str, name: str) -> Shard:
    """Maps a file of the shared folder; from a store that can't be mapped, a local copy that vanishes with its last reader."""
    store, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if isinstance(store, pafs.LocalFileSystem):
        return Shard(np.memmap(path, dtype=np.uint8, mode="r"))
    fd, local = tempfile.mkstemp()
    try:
        with os.fdopen(fd, "wb") as out, store.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                out.write(part)
        return Shard(np.memmap(local, dtype=np.uint8, mode="r"))
    finally:
        os.unlink(local)


class Model:
    """The trie's files, by shard, the totals of its training tokens and texts, and the discount of its triples."""

    def __init__(self, folder: str, names: list[str | None], n: int, v: int, texts: int, discount: float):
        self.folder, self.names, self.n, self.v, self.texts, self.discount = folder, names, n, v, texts, discount

    def _runs(self, hashes: np.ndarray) -> Iterator[tuple[Shard, int, int]]:
        """The shards that sorted hashes fall into, and which of them do."""
        edges = np.searchsorted(shard_of(hashes, len(self.names)), np.arange(len(self.names) + 1)) if self.names else [0]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            if self.names[k]:
                yield open_shard(self.folder, self.names[k]), int(edges[k]), int(edges[k + 1])

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By row: tokens, known tokens, base score, score."""
        h, bounds = tokens(texts)
        first = bounds[:-1]
        words, word = np.unique(h, return_inverse=True)
        count = np.zeros(len(words), dtype=np.int64)
        for shard, a, b in self._runs(words):
            count[a:b] = shard.word_counts(words[a:b])
        base = (count + 1) / (self.n + self.v + 1)
        pairs, place, context = pairs_of(h, first)
        triple, which = np.unique((context.astype(U64) << U64(32)) | word.astype(U64), return_inverse=True)
        left, right = (triple >> U64(32)).astype(np.int64), (triple & U64(0xFFFFFFFF)).astype(np.int64)
        edges = np.searchsorted(left, np.arange(len(pairs) + 1))
        times, before, number = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64), np.zeros(len(triple), dtype=np.int64)
        for shard, a, b in self._runs(pairs):
            times[a:b], start, end = shard.pair_counts(pairs[a:b])
            before[a:b] = end - start
            ask = edges[a] + np.flatnonzero(before[left[edges[a] : edges[b]]])
            own = left[ask] - a
            number[ask] = shard.triple_counts(pairs[left[ask]], start[own], end[own], words[right[ask]])
        after = np.empty(len(h), dtype=np.int64)  # how often the word before each token was followed by any
        after[1:] = count[word[:-1]]
        after[first] = self.texts
        second = (times[place] + PRIOR * base[word]) / (after + PRIOR)
        total, number, followers = times[context], number[which], before[context]
        seen = followers > 0
        total = np.where(seen, total, 1)
        third = np.where(seen, (np.maximum(number - self.discount, 0) + self.discount * followers * second) / total, second)
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x
        return np.diff(bounds), sums((count > 0)[word].astype(np.int64)), sums(np.log10(base)[word]), sums(np.minimum(np.log10(third), 0.0))


def build(training: DataFrame, shards: int = 0) -> Model:
    """The model of the column ``text`` of ``training``."""
    spark = training.sparkSession
    scratch = Scratch(spark, "trie")
    if not shards:
        size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            at = np.cumsum([0, *(len(h) for h, _ in held[:-1])])
            h, first = np.concatenate([h for h, _ in held]), np.concatenate([f + k for (_, f), k in zip(held, at, strict=True)])
            held.clear()
            rows = count_blocks(h, first, shards)
            while part := [row for _, row in zip(range(64), rows, strict=False)]:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], ["shard", "block"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                h, bounds = tokens(texts.slice(a, b - a))
                held.append((h, bounds[:-1]))
                n += len(h)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    folder = f"{scratch.path}/levels"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: OrderedDict[int, list[bytes]] = OrderedDict()
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks.setdefault(k, []).append(b)
        store, base = pafs.FileSystem.from_uri(folder)
        while blocks:
            k, own = blocks.popitem()
            merged = merge_blocks(own)
            count, number = merged[1], merged[5]
            name = f"{k}-{os.urandom(8).hex()}.trie"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(trie_bytes(*merged))
            texts = merged[3][merged[2] == START_PAIR[0]]
            row = {"shard": k, "name": name, "n": int(count.sum()), "v": len(count), "texts": int(texts.sum()), "n1": int((number == 1).sum()), "n2": int((number == 2).sum())}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("name", pa.string()), *((c, pa.int64()) for c in ("n", "v", "texts", "n1", "n2"))]))

    blocks = small_batches(training).select("text").mapInArrow(count, "shard int, block binary")
    dealt = blocks.repartitionById(shards, F.col("shard"))
    manifest = scratch.write(dealt.mapInArrow(merge, "shard int, name string, n long, v long, texts long, n1 long, n2 long"), "manifest").collect()
    names: list[str | None] = [None] * shards
    for r in manifest:
        names[r.shard] = r.name
    n, v, texts, n1, n2 = (sum(r[c] for r in manifest) for c in ("n", "v", "texts", "n1", "n2"))
    return Model(folder, names, n, v, texts, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, 1 << 21):
                n, known, base, score = shared.value.score(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(x) for x in (n.astype(np.int64), known, base, score))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def judge(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the score per token."""
    model = build(documents.where(fold(F.col("doc_id")) != 2).select("text"))
    scored = score_documents(documents, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))
