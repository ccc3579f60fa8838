"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Fit, on a bounded sample (SAMPLE vectors in the order of a hash of the id): principal
axes, then rotations learned by alternating sign codes and an orthogonal Procrustes
step, so that the bits are balanced and lose little; each start gives a rotation of its own.
Every vector is then coded.  Codes are cut into tables of ``width`` bits, some log2 of the
number of vectors, so that a bucket stays small as the table grows; of tables there are as
many as pairs at the threshold, drawn around sample vectors, need to meet with probability
RECALL.  Each substring is stored under itself and all strings one bit away, so two vectors
meet in a table if their substrings differ in at most two bits.  A pair is looked at once:
in its first such table, under one of its common keys.  Every pair that meets is reranked by
the cosine of the original vectors in double precision, but for pairs that a bound proves to
lie below the threshold: on any orthonormal axes, vectors are at most as far apart as they
are in full, and AXES principal components in 8 bits, with their rounding allowed for, travel
with the code.

Equal vectors form a class first and meet as one.  Buckets of LIGHT members or fewer give
pairs, so pairs grow with the number of vectors.  A fuller bucket gets its vectors, is cut
into chunks that are compared chunk against chunk, and gives counts of links and spanning
edges instead: what a group of near-equal vectors gives grows with its size, not its square.

Vectors of another length than those the sample has enough of are coded by random planes that
follow from the length; only vectors of one length meet.

Defined results: vectors that are null, empty, zero, or have null or non-finite components
link with nothing; so does a null vec_id, whose row comes back with n_links 0, component_id
null and kept false.  Repeated vec_ids count as further vectors, each row with its own links.
Further columns, whatever their names, are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import crossing, deal, spanning
from .components import connected_components
from .scratch import Scratch

THRESHOLD, SAMPLE, ROUNDS = 0.9, 8192, 40
#: What probability of meeting the number of tables is chosen for, and between which numbers; bits of a table; bits of a rotation.
RECALL, TABLES, WIDTHS, BITS = 0.985, (4, 16), (12, 32), 64
AXES, LIGHT, CHUNK = 16, 128, 1024
#: Vectors of a length, in the sample, from which on rotations are learned; rows of a bucket task.
ENOUGH, TASK_ROWS = 64, 1 << 17


@dataclass
class Coder:
    """A vector's bits are the signs of (v/|v| - centre) @ plane, ``width`` for each table; ``axes`` are orthonormal columns, AXES at most."""

    centre: np.ndarray
    plane: np.ndarray
    axes: np.ndarray
    width: int

    def code(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) substrings."""
        bits = (unit - self.centre) @ self.plane > 0
        bits = bits.reshape(len(unit), -1, self.width).astype(np.uint32)
        return (bits << np.arange(self.width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """Components on the axes in steps of 1/127."""
        out = np.zeros((len(unit), AXES), dtype=np.int8)
        out[:, : self.axes.shape[1]] = np.rint(np.clip(unit @ self.axes, -1, 1) * 127)
        return out


def learn(unit: np.ndarray, width: int = 16, tables: int = TABLES[0], rounds: int = ROUNDS, seed: int = 5) -> Coder:
    """Iterative quantisation over unit vectors: as many rotations as the tables need.

    With fewer dimensions than bits of a table, its planes are completed by random directions of the same space.
    """
    rng = np.random.default_rng(seed)
    centre = unit.mean(axis=0)
    x = unit - centre
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :BITS]
    v = x @ axes
    d = axes.shape[1]
    planes: list[np.ndarray] = []
    while len(planes) < tables:
        rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            code = np.where(v @ rotation > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(code.T @ v)
            rotation = (u @ w).T
        plane = (axes @ rotation)[:, rng.permutation(d)]
        if d < width:
            plane = np.concatenate([plane, rng.standard_normal((unit.shape[1], width - d))], axis=1)
        planes += [plane[:, k : k + width] for k in range(0, plane.shape[1] - width + 1, width)]
    return Coder(centre, np.concatenate(planes[:tables], axis=1), axes[:, :AXES], width)


@functools.lru_cache(maxsize=64)
def unlearned(dim: int, width: int, tables: int) -> Coder:
    """A coder for vectors of a length that the sample has too few of: random planes, the same wherever it is made."""
    rng = np.random.default_rng([dim, 17])
    axes, _ = np.linalg.qr(rng.standard_normal((dim, min(dim, AXES))))
    return Coder(np.zeros(dim), rng.standard_normal((dim, width * tables)), axes, width)


def meeting(coder: Coder, unit: np.ndarray, threshold: float, seed: int = 6) -> np.ndarray:
    """The share of pairs at the threshold that have met by each table: the worse of those apart by noise and of those apart towards other vectors."""
    rng = np.random.default_rng(seed)
    out = np.ones(coder.plane.shape[1] // coder.width)
    for away in (rng.standard_normal(unit.shape), unit[rng.permutation(len(unit))]):
        away = away - (away * unit).sum(axis=1)[:, None] * unit
        norm = np.linalg.norm(away, axis=1)
        u, away = unit[norm > 1e-9], (away / np.maximum(norm, 1e-300)[:, None])[norm > 1e-9]
        if len(u):
            near = np.bitwise_count(coder.code(u) ^ coder.code(threshold * u + np.sqrt(max(1 - threshold**2, 0)) * away)) <= 2
            out = np.minimum(out, np.maximum.accumulate(near, axis=1).mean(axis=0))
    return out


def units_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) of the vectors that can link, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    there = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for dim in np.unique(length[there]).tolist():
        rows = np.flatnonzero(there & (length == dim))
        if not dim:
            continue
        v = values[offsets[rows][:, None] + np.arange(dim)]
        top = np.abs(v).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        if good.any():
            v = v[good] / top[good][:, None]
            yield rows[good], v / np.linalg.norm(v, axis=1)[:, None]


def fit(vectors: DataFrame, n: int, threshold: float = THRESHOLD, sample: int = SAMPLE) -> tuple[dict[int, Coder], int, int] | None:
    """(coders by length, bits of a table, tables) for ``n`` vectors; None without a valid vector in the sample."""
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    found = {u.shape[1]: u for _, u in units_of(rows.column(0))} if rows.num_rows else {}
    if not found:
        return None
    width = int(np.clip(np.ceil(np.log2(max(n, 2))), *WIDTHS))
    main = max(found.values(), key=len)
    enough = meeting(learn(main, width, TABLES[1]), main[:2048], threshold) >= RECALL
    tables = max(TABLES[0], int(np.argmax(enough)) + 1 if enough.any() else TABLES[1])
    return {dim: learn(u, width, tables) for dim, u in found.items() if len(u) >= ENOUGH}, width, tables


CODED = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("code", pa.binary()), ("sketch", pa.binary()), ("class", pa.binary()), ("vector", pa.binary())])


def encode(vectors: DataFrame, coders: dict[int, Coder], width: int, tables: int) -> DataFrame:
    """(vec_id, dim, code, sketch, class, vector) of every row; all but vec_id are null where it can't link. Vectors are in the precision they came in."""
    shared = vectors.sparkSession.sparkContext.broadcast(coders)
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                ids = part.column(0)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                out: list[list] = [[None] * part.num_rows for _ in range(5)]
                given = part.column(1).cast(pa.large_list(pa.float64()))
                values, offsets = given.values.to_numpy(zero_copy_only=False), given.offsets.to_numpy()
                for rows, unit in units_of(part.column(1)):
                    dim = unit.shape[1]
                    coder = shared.value.get(dim) or unlearned(dim, width, tables)
                    code, sketch = coder.code(unit), coder.sketch(unit)
                    for k, r in enumerate(rows.tolist()):
                        if named[r]:
                            raw = values[offsets[r] : offsets[r] + dim].astype(np.float32 if single else np.float64)
                            for column, value in zip(out, (dim, code[k].tobytes(), sketch[k].tobytes(), hashlib.md5(unit[k].tobytes()).digest(), raw.tobytes()), strict=True):
                                column[r] = value
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, f.type) for x, f in zip(out, list(CODED)[1:], strict=True))], schema=CODED)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dim int, code binary, sketch binary, class binary, vector binary")


def stacked(column, kind: type) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def keys(code: np.ndarray, width: int, dim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, code numbers): for each table, the substring and its neighbours one bit away; tables from bit 32 on, lengths from bit 37 on."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int64)
    table = np.arange(code.shape[1], dtype=np.int64)[None, :, None] << 32
    out = (code.astype(np.int64)[:, :, None] ^ flips) | table | (dim.astype(np.int64)[:, None, None] << 37)
    return out.reshape(-1), np.repeat(np.arange(len(code)), code.shape[1] * len(flips))


def probes(classes: DataFrame, width: int) -> DataFrame:
    """(key, node, code, sketch): one row for each key of each class."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("code", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                k, row = keys(stacked(part.column(2), np.uint32), width, part.column(1).to_numpy())
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(k), *(part.column(c).take(at) for c in (0, 2, 3))], schema=schema)

    return classes.select("node", "dim", "code", "sketch").mapInArrow(run, "key long, node long, code binary, sketch binary")


def possible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether vectors of these sketches can reach the threshold; never false for those that do."""
    away = a.astype(np.int16) - b
    rounding = np.sqrt(AXES) + 1e-6  # each component is off by half a step at most, on both sides
    return np.sqrt(np.einsum("ij,ij->i", away, away, dtype=np.int64)) <= 127 * np.sqrt(max(2 - 2 * threshold, 0)) + rounding


def met(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether pairs of codes are to be looked at under these keys: the first table where they meet, and one common key there."""
    table = ((key >> 32) & 31).astype(np.int64)
    x = a ^ b
    near = np.bitwise_count(x) <= 2
    mine = near.argmax(axis=1) == table
    at = np.arange(len(x))
    own, u, v = x[at, table], a[at, table], b[at, table]
    one = own & (~own + np.uint32(1))
    chosen = np.where(np.bitwise_count(own) == 2, np.minimum(u ^ one, v ^ one), np.minimum(u, v))
    return mine & near[at, table] & (chosen == (key & 0xFFFFFFFF).astype(np.uint32))


def light_pairs(probed: DataFrame, tasks: int, threshold: float) -> DataFrame:
    """(a, b): pairs of classes, a < b, each once, that small buckets bring together and that can reach the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        key, node = table["key"].to_numpy(), table["node"].to_numpy()
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        code, sketch = stacked(table["code"], np.uint32)[order], stacked(table["sketch"], np.int8)[order]
        found, apart = [], 1
        while len(at := np.flatnonzero(key[:-apart] == key[apart:])):
            for low in range(0, len(at), 1 << 17):
                i = at[low : low + (1 << 17)]
                i = i[met(code[i], code[i + apart], key[i])]
                i = i[possible(sketch[i], sketch[i + apart], threshold)]
                found.append(np.stack([node[i], node[i + apart]]))
            apart += 1
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        return pa.Table.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], schema=schema)

    dealt = probed.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


LINKED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _units(vectors, single: bool) -> np.ndarray:
    v = stacked(vectors, np.float32 if single else np.float64).astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def heavy_links(members: DataFrame, threshold: float, single: bool) -> DataFrame:
    """``members`` (task, part, side, key, node, n, code, vector) to (node, links, other): counted links, and spanning edges."""

    def run(table: pa.Table) -> pa.Table:
        key, node, n, side = (table[c].to_numpy() for c in ("key", "node", "n", "side"))
        text = table["part"].combine_chunks().dictionary_encode()
        part, names = text.indices.to_numpy(), text.dictionary.to_pylist()
        order = np.argsort(part, kind="stable")
        out = [np.zeros((3, 0), dtype=np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            some = table.take(pa.array(rows))
            unit, code, own = _units(some["vector"], single), stacked(some["code"], np.uint32), side[rows]
            near = unit @ unit.T >= threshold
            if crossing(names[part[rows[0]]]):
                near &= own[:, None] != own[None, :]
            i, j = np.nonzero(np.triu(near, 1))
            near[:] = False
            for low in range(0, len(i), 1 << 17):
                a, b = i[low : low + (1 << 17)], j[low : low + (1 << 17)]
                good = met(code[a], code[b], key[rows[a]])
                near[a[good], b[good]] = near[b[good], a[good]] = True
            low = spanning(near)
            linked = np.flatnonzero(near.any(axis=1))
            out.append(np.stack([node[rows[linked]], near[linked].astype(np.int64) @ n[rows], node[rows[low[linked]]]]))
        return pa.Table.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], schema=LINKED)

    return members.groupBy("task").applyInArrow(run, "node long, links long, other long")


def reranked(pairs: DataFrame, vectors: DataFrame, threshold: float, single: bool) -> DataFrame:
    """Of ``pairs`` (a, b) of ``vectors`` (node, n, vector), those whose cosine reaches the threshold, as (node, links, other) from both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(6))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for low in range(0, len(rows), 8192):
                    part = batch.take(pa.array(rows[low : low + 8192]))
                    cosine = np.einsum("ij,ij->i", *(_units(part.column(k), single) for k in (4, 5)))
                    good = np.flatnonzero(cosine >= threshold)
                    a, b, na, nb = (part.column(k).to_numpy()[good] for k in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((a, b), (nb, na), (b, a))], schema=LINKED)

    left, right = (vectors.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("vector").alias(f"v_{x}"), *extra) for x, extra in (("a", ["dim"]), ("b", [])))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "v_a", "v_b", "dim")
    return joined.mapInArrow(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "itq")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    found = fit(vectors, vectors.count(), threshold)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    coded = scratch.write(encode(vectors, *found), "coded")
    linking = coded.where("class is not null")
    by_class = linking.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("dim", "code", "sketch", "vector")))
    by_class = scratch.write(by_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    probed = probes(by_class, found[1])
    sizes = scratch.write(probed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    rows = sizes.agg(F.sum(F.when(F.col("size") <= LIGHT, F.col("size"))).alias("light"), F.sum(F.when(F.col("size") > LIGHT, F.col("size"))).alias("heavy")).first()
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slim = by_class.select("node", "dim", "n", "vector")
    pairs = light_pairs(probed.join(sizes.where(F.col("size") <= LIGHT).select("key"), "key"), max(least, (rows.light or 0) // TASK_ROWS), threshold)
    links = reranked(scratch.write(pairs, "pairs"), slim, threshold, single)
    if rows.heavy:
        heavy = probed.drop("sketch").join(sizes.where(F.col("size") > LIGHT).select("key"), "key").join(slim.drop("dim"), "node")
        links = links.union(heavy_links(deal(heavy, "key", "node", CHUNK, tasks=max(least, rows.heavy * 8 // TASK_ROWS)), threshold, single))
    links = scratch.write(links.groupBy("node", "other").agg(F.sum("links").alias("links")), "links")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(links.select(F.col("node").alias("src"), F.col("other").alias("dst")), scratch)
    leads = groups.join(by_class.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lead"))
    joined = by_class.select("class", "node", "rep", "n").join(degree, "node", "left").join(groups.join(leads, "component").select("node", "lead"), "node", "left")
    joined = joined.select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lead", "rep").alias("component_id"))
    linked = linking.select("vec_id", "class").join(joined, "class").select("vec_id", "n_links", "component_id")
    alone = coded.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for table in ("sizes", "pairs"):
        scratch.drop(table)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
