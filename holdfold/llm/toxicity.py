"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with border marks) and of
the word itself, all hashed into one table; a window of words is the mean of its words;
a linear softmax judges windows.  Table and softmax are trained together by Adagrad.
Labels are of documents, so training first calls every window of a toxic document
toxic, and then, in later epochs, only the windows that the model itself ranks highest
there, against those ranked highest in clean documents and others.  A document's score
is a calibrated logistic of its highest window, over all its windows.

Since the model is linear, a word's part in the logit is the mean of one number per
n-gram; workers get that one vector (1 << BITS numbers), nothing that grows with data.

Training reads a bounded sample: MOST_DOCUMENTS labelled ids, half of each class where
there are enough, in the order of a hash of doc_id, one row of each id, and of that row's
text MOST_WINDOWS windows, drawn where the row lies.  The calibration's documents, a fifth
of the sample, are scored whole, and only their numbers come back.  Scoring reads whole texts.

Defined results: a null or empty text, or one without words, scores as a window without
evidence; rows with a null doc_id are scored and never held out; repeated rows each get
a row; without labelled rows of both classes every score is the share of label 1 among
them (0 without any); an empty table gives an empty result.  Other columns of any name are
ignored by :func:`judge` and kept by :func:`clean`.  A text is scanned in pieces: a worker
holds it, some 25 bytes for each of its words, and nothing larger, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .textscan import U64, Scan, _powers_to, by_row, mix, scan, slices

BITS, WIDTH, WINDOW = 17, 8, 3
SIZES = (3, 4, 5)
MOST_DOCUMENTS, MOST_WINDOWS = 2000, 768
SEED = 7
#: Words whose part in the logit a worker remembers, and words whose n-grams it takes apart at once.
REMEMBERED, AT_ONCE = 1 << 16, 1 << 13


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table slots, word numbers), by word, of the n-grams of the words at the byte ranges."""
    count = len(start)
    if not count:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    length = end - start
    at = np.concatenate([[0], np.cumsum(length + 2)])
    raw = np.empty(at[-1], dtype=np.uint8)
    raw[at[:-1]], raw[at[1:] - 1] = ord("<"), ord(">")
    inner = np.ones(at[-1], dtype=bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    raw[inner] = data[np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.add.reduceat((raw & 0xC0) != 0x80, at[:-1]))
    if ends[-1] != len(points):  # bytes that aren't UTF-8: each stands for itself
        points, ends = raw.astype(np.uint32), at[1:]
    starts = np.concatenate([[0], ends[:-1]])
    power, inverse = _powers_to(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=U64)
    np.cumsum((points.astype(U64) + U64(1)) * power[: len(points)], out=total[1:])
    owner = np.repeat(np.arange(count), ends - starts)
    slots, words = [mix((total[ends] - total[starts]) * inverse[starts])], [np.arange(count)]
    for n in SIZES:
        p = np.flatnonzero(np.arange(len(points)) + n <= ends[owner])
        slots.append(mix((total[p + n] - total[p]) * inverse[p] + U64(n)))
        words.append(owner[p])
    slot, word = (np.concatenate(slots) >> U64(64 - BITS)).astype(np.int64), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return slot[order], word[order]


@dataclass
class Model:
    """``weight``: each slot's part in the logit; ``bias``; ``slope`` and ``offset`` of the calibration."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    _seen: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0, dtype=U64), np.zeros(0)), repr=False)

    def parts(self, s: Scan) -> np.ndarray:
        """Each word's part in the logit; those of up to REMEMBERED words are kept for the next call."""
        words, first, which = np.unique(s.hash, return_index=True, return_inverse=True)
        known, values = self._seen
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        old = known[at] == words if len(known) else np.zeros(len(words), dtype=bool)
        own = np.empty(len(words))
        own[old] = values[at[old]]
        new = np.flatnonzero(~old)
        for low in range(0, len(new), AT_ONCE):
            some = new[low : low + AT_ONCE]
            slot, word = features(s.data, s.start[first[some]], s.end[first[some]])
            own[some] = np.bincount(word, weights=self.weight[slot], minlength=len(some)) / np.bincount(word, minlength=len(some))
        if len(known) + len(new) <= REMEMBERED:
            known, values = np.concatenate([known, words[new]]), np.concatenate([values, own[new]])
            order = np.argsort(known)
            self._seen = known[order], values[order]
        elif len(words) <= REMEMBERED:
            self._seen = words, own
        return own[which]

    def highest(self, s: Scan) -> np.ndarray:
        """Each row's highest window logit; the bias for rows without words."""
        if not len(s.hash):
            return np.full(s.rows, self.bias)
        total = np.concatenate([[0.0], np.cumsum(self.parts(s))])
        left = np.arange(len(s.hash))
        right = np.minimum(left + WINDOW, s.bounds[1:][s.row])
        lone = s.bounds[:-1][s.row] == left
        mean = (total[right] - total[left]) / (right - left)
        mean[(right - left < WINDOW) & ~lone] = -np.inf
        return by_row(np.maximum, mean + self.bias, s.bounds, self.bias)

    def score(self, s: Scan) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(s) + self.offset, -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic fit, by Newton's method with a small ridge."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / spread, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (p - y) + 0.05 * w)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def train(texts: list[str | None], labels: list[int], steps: list[int] | None = None, highest: Callable[[Model, np.ndarray], np.ndarray] | None = None) -> Model:
    """The model from labelled texts; the same input gives the same model.

    ``steps``: how many words a text's windows lie apart, one as a rule, WINDOW where the text is a
    row of drawn windows.  ``highest``: the highest window logits of the documents with these
    numbers, for the calibration; by default those of ``texts``.
    """
    y = np.asarray(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if len(np.unique(y)) < 2:
        prior = -50.0 if share == 0 else 50.0
        return Model(np.zeros(1 << BITS), 0.0, 0.0, prior)
    rng = np.random.default_rng(SEED)
    column = pa.array(texts, pa.string())
    owner, member, known, lengths, slots = [], [], [], [], []
    seen = np.zeros(0, dtype=U64)
    for low, high in slices(column, 1 << 18):  # what is held of a slice: hashes of chosen words, and their features
        s = scan(column.slice(low, high - low))
        for r in range(s.rows):
            lo, hi = s.bounds[r], s.bounds[r + 1]
            starts = np.arange(lo, max(hi - WINDOW + 1, lo + (hi > lo)), steps[low + r] if steps else 1)
            owner.append(np.full(len(starts), low + r))
            member.append(s.hash[np.stack([np.minimum(starts + k, hi - 1) for k in range(WINDOW)], axis=1)])
        mine = np.isin(s.hash, np.concatenate(member[-s.rows :]).ravel())
        own, first = np.unique(s.hash[mine], return_index=True)
        new = ~np.isin(own, seen, assume_unique=True)
        own, first = own[new], np.flatnonzero(mine)[first[new]]
        seen = np.union1d(seen, own)
        slot, word = features(s.data, s.start[first], s.end[first])
        known.append(own)
        lengths.append(np.bincount(word, minlength=len(own)))
        slots.append(slot.astype(np.int32))
    length, slot = np.concatenate(lengths), np.concatenate(slots)
    del lengths, slots, s
    by_hash = np.argsort(np.concatenate(known))
    hashes = np.concatenate(known)[by_hash]
    begin, edge = np.cumsum(length) - length, np.linspace(0, len(length), 33).astype(np.int64)
    begin_of, size_of = begin[by_hash], length[by_hash]

    def parts_of(weight: np.ndarray) -> np.ndarray:
        """Each known word's part in the logit, some words at a time."""
        out = [np.add.reduceat(weight[slot[begin[a] : begin[b - 1] + length[b - 1]]], begin[a:b] - begin[a]) for a, b in zip(edge, edge[1:], strict=False) if a < b]
        return (np.concatenate(out) / length)[by_hash]

    owner = np.concatenate(owner)
    member = np.searchsorted(hashes, np.concatenate(member)).astype(np.int32)
    keep_out = rng.random(len(y)) < 0.2  # for calibration
    table = rng.uniform(-1, 1, (1 << BITS, WIDTH)).astype(np.float32) / WIDTH
    soft, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    g_table, g_soft, g_bias = np.full(1 << BITS, 1e-6, dtype=np.float32), np.full((WIDTH, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def epoch(chosen: np.ndarray, target: np.ndarray, rate: float, batch: int = 4096) -> None:
        nonlocal bias, soft
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // batch)):
            m, t = member[chosen[part]], target[part]
            used, local = np.unique(m, return_inverse=True)
            local = local.reshape(m.shape)
            n = size_of[used]
            begin = np.cumsum(n) - n
            flat = slot[np.repeat(begin_of[used] - begin, n) + np.arange(n.sum())]
            vector = np.add.reduceat(table[flat], begin, axis=0) / n[:, None].astype(np.float32)
            h = vector[local].mean(axis=1)
            z = h @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = p.astype(np.float32)
            d[np.arange(len(t)), t] -= 1
            d /= len(t)
            d_soft, d_bias, d_h = h.T @ d, d.sum(axis=0), d @ soft.T / WINDOW
            d_word = np.stack([np.bincount(local.ravel(), weights=np.repeat(d_h[:, j], WINDOW), minlength=len(used)) for j in range(WIDTH)], axis=1)
            d_flat = np.repeat(d_word / n[:, None], n, axis=0)
            slots, where = np.unique(flat, return_inverse=True)
            d_slot = np.stack([np.bincount(where, weights=d_flat[:, j], minlength=len(slots)) for j in range(WIDTH)], axis=1).astype(np.float32)
            g_table[slots] += (d_slot**2).mean(axis=1)
            table[slots] -= rate * d_slot / np.sqrt(g_table[slots])[:, None]
            g_soft[:] += d_soft**2
            g_bias[:] += d_bias**2
            soft -= rate * d_soft / np.sqrt(g_soft)
            bias = bias - rate * d_bias / np.sqrt(g_bias)

    def model() -> Model:
        return Model(table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]), 1.0, 0.0)

    trained = np.flatnonzero(~keep_out[owner])
    few = trained[rng.random(len(trained)) < 1 / WINDOW]
    for _ in range(2):
        epoch(few, y[owner[few]], 0.2)
    for _ in range(3):
        weight, b = (m := model()).weight, m.bias
        own = parts_of(weight)
        value = sum(own[member[:, k]] for k in range(WINDOW)) / WINDOW + b
        order = trained[np.lexsort((-value[trained], owner[trained]))]
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        hard = order[rank < np.where(y[owner[order]] == 1, 2, 6)]
        other = few[y[owner[few]] == 0]
        other = other[rng.random(len(other)) < min(1.0, 3 * len(hard) / max(1, len(other)))]
        chosen = np.concatenate([hard, other])
        for _ in range(2):
            epoch(chosen, y[owner[chosen]], 0.2, 1024)
    out = model()
    fit = np.flatnonzero(keep_out) if len(np.unique(y[keep_out])) == 2 else np.arange(len(y))
    if highest is None:
        kept = column.take(pa.array(fit))
        high = np.concatenate([out.highest(scan(kept.slice(a, b - a))) for a, b in slices(kept)])
    else:
        high = highest(out, fit)
    out.slope, out.offset = _logistic(high, y[fit])
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def drawn(text: str | None, doc_id: int) -> tuple[str | None, int]:
    """(text, step) for training: the whole text, or MOST_WINDOWS of its windows one after the other."""
    s = scan(pa.array([text], pa.string()))
    n = len(s.hash) - WINDOW + 1
    if n <= MOST_WINDOWS:
        return text, 1
    starts = np.sort(np.random.default_rng([SEED, doc_id & 0xFFFFFFFF]).choice(n, MOST_WINDOWS, replace=False))
    return " ".join(s.word(i + k) for i in starts.tolist() for k in range(WINDOW)), WINDOW


def learn(documents: DataFrame, labels: DataFrame, most: int = MOST_DOCUMENTS) -> Model:
    """Trains on at most ``most`` labelled documents outside the held-out fold."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_order", F.xxhash64("doc_id"))
    picked = [rows.where(F.col("toxic") == k).orderBy("_order", "doc_id").limit(most // 2) for k in (0, 1)]
    wanted = {r.doc_id: r.toxic for part in picked for r in part.collect()}
    if not wanted:
        return train([], [])
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    ids = spark.createDataFrame([(k,) for k in wanted], "doc_id long")
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    chosen = scratch.write(found, "chosen")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [drawn(t, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([k for _, k in got], pa.int32())], ["doc_id", "text", "step"])

    sample = sorted(chosen.mapInArrow(draw, "doc_id long, text string, step int").collect(), key=lambda r: r.doc_id)
    numbers = {r.doc_id: k for k, r in enumerate(sample)}

    def highest(model: Model, fit: np.ndarray) -> np.ndarray:
        scored = {r.doc_id: r.score for r in _mapped(chosen, model.highest).collect()}
        of = {numbers[i]: x for i, x in scored.items()}
        return np.array([of[int(k)] for k in fit])

    try:
        return train([r.text for r in sample], [wanted[r.doc_id] for r in sample], [r.step for r in sample], highest)
    finally:
        scratch.drop()


def _mapped(documents: DataFrame, function: Callable[[Scan], np.ndarray]) -> DataFrame:
    """Per row: doc_id, and ``function`` of its scanned text as ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(function)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(shared.value(scan(texts.slice(a, b - a))))], ["doc_id", "score"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score."""
    return _mapped(documents, model.score)


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = score_documents(documents, learn(documents, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents``, all their columns, with a score under 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for a, b in slices(texts):
                keep = shared.value.score(scan(texts.slice(a, b - a))) < 0.5
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return small_batches(documents).mapInArrow(run, documents.schema)
