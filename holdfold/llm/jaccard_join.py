"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Bands and rows follow from the recall wanted at the threshold.  Documents with equal
n-gram sets form a class; signatures of classes meet on band hashes.  A bucket only links
its members to its smallest class, and the connected candidates are then compared with
each other on their full n-gram sets: a group that many documents fall into is cut into
chunks and compared chunk against chunk.  Results are a count of links per class and
spanning edges, not pairs.

Defined results: n-grams are runs of five words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``,
A-Z lower-cased); a document with fewer words has one n-gram, all its words; one without
words, null texts included, links with nothing and is kept.  What links is a row's text:
rows of one doc_id with different texts belong to different classes and keep apart.  A row
with a null doc_id is judged under an id of its own, a negative number made from its text,
and returned with a null doc_id.  Repeated rows are copies of each other.  An empty table
gives an empty result.  Further columns, whatever their names, are ignored by :func:`classes`
and kept by :func:`representatives`.  Long texts are scanned in pieces; a worker holds a
text and its n-gram hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import HEAVY, crossing, deal, spanning
from .components import connected_components
from .scratch import Scratch, small_batches
from .textscan import U64, by_row, mix, scan, shingles, slices

THRESHOLD, RECALL, WORDS, PERMUTATIONS = 0.8, 0.999, 5, 160


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = PERMUTATIONS) -> tuple[int, int]:
    """The most rows per band with which enough bands for the recall fit into ``most`` permutations.

    A pair at the threshold shares a band with probability 1 - (1 - t^r)^b; more rows let fewer dissimilar pairs meet.
    """
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(threshold**rows, 1 - 1e-12)))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def own_id() -> Column:
    """doc_id, or for a null one a negative number made from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), -F.shiftrightunsigned(F.xxhash64("text"), 2) - 1)


def text_key() -> Column:
    """Tells rows of one id apart: equal for equal texts."""
    return F.xxhash64("text")


def signatures(documents: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(id, key, doc_id, class, bands): per row, its n-gram set's 128-bit hash and band hashes; null class without words."""
    bands, rows = bands_and_rows(threshold)
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *given, texts = batch.columns
            for a, b in slices(texts):
                value, bounds = shingles(scan(texts.slice(a, b - a)), words)
                n = b - a
                full = np.diff(bounds) > 0
                hashed = np.empty((n, bands), dtype=U64)
                for k in range(bands):
                    h = np.full(n, k + 1, dtype=U64)
                    for j in range(rows):
                        h = mix(h + by_row(np.minimum, value * odd[k * rows + j], bounds, 0))
                    hashed[:, k] = h
                mixed = mix(value)
                low, high = by_row(np.add, mixed, bounds, 0), by_row(np.bitwise_xor, value, bounds, 0)
                key = np.stack([low, mix(high + U64(1) + np.diff(bounds).astype(U64))], axis=1)
                name = [key[r].tobytes() if full[r] else None for r in range(n)]
                flat = pa.array(hashed.view(np.int64).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([*(x.slice(a, n) for x in given), pa.array(name, pa.binary()), listed], schema=schema)

    doc_id = F.col("doc_id").cast("long")
    own = own_id()
    return small_batches(documents).select(own.alias("id"), text_key().alias("key"), doc_id.alias("doc_id"), "text").mapInArrow(run, "id long, key long, doc_id long, class binary, bands array<long>")


def n_gram_sets(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``rows`` (id, n, grp, text) with the text replaced by its sorted n-gram hashes ``grams``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("grp", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *given, texts = batch.columns
            for a, b in slices(texts):
                value, bounds = shingles(scan(texts.slice(a, b - a)), words)
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([x.slice(a, b - a) for x in given] + [listed], schema=schema)

    return rows.select("id", "n", "grp", "text").mapInArrow(run, "id long, n long, grp long, grams array<long>")


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float, width: int = 2048, ranges: int = 8) -> np.ndarray:
    """Boolean matrix of the pairs, of a set on the left and one on the right, that reach the threshold.

    N-grams are counted range by range of their hashes, so what is held beside the sets is a part of them.
    """
    m, n = len(left), len(right)
    sets = [x.view(U64) for x in (*left, *right)]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    common = np.zeros((m, n), dtype=np.float32)
    for r in range(ranges):
        some = [x[(x >> U64(32)) * U64(ranges) >> U64(32) == U64(r)] for x in sets]
        value, owner = np.concatenate(some), np.repeat(np.arange(m + n, dtype=np.int32), [len(x) for x in some])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, dtype=bool)
        gram = np.cumsum(new, dtype=np.int32) - 1
        shared = np.bincount(gram)[gram] > 1 if len(gram) else new
        owner, gram = owner[shared], gram[shared]
        gram = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])) if len(gram) else gram
        for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, width):
            a, b = np.searchsorted(gram, [low, low + width])
            part = np.zeros((m + n, width), dtype=np.float32)
            part[owner[a:b], gram[a:b] - low] = 1
            common += part[:m] @ part[m:].T
    out = np.zeros((m, n), dtype=bool)
    for low in range(0, m, 256):
        c = common[low : low + 256].astype(np.float64)
        out[low : low + 256] = (c > 0) & (c >= threshold * (size[low : min(low + 256, m), None] + size[None, m:] - c) - 1e-9)
    return out


def verify(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``members`` (task, part, side, id, n, grams) to (id, links, other): counted links, and spanning edges."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        text = table["part"].combine_chunks().dictionary_encode()
        part, names = text.indices.to_numpy(), text.dictionary.to_pylist()
        ids, n, side = (table[c].to_numpy() for c in ("id", "n", "side"))
        grams = table["grams"].combine_chunks()
        flat, bounds = grams.values.to_numpy(), grams.offsets.to_numpy()
        out = []
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(part[order][1:] != part[order][:-1]) + 1):
            if len(rows) < 2:
                continue
            crosses = crossing(names[part[rows[0]]])
            left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if crosses else (rows, rows)
            if not len(left) or not len(right):
                continue
            sets = lambda of: [flat[bounds[r] : bounds[r + 1]] for r in of]
            near = linked(sets(left), sets(right), threshold)
            if crosses:
                rows, between = np.concatenate([left, right]), near
                near = np.zeros((len(rows), len(rows)), dtype=bool)
                near[: len(left), len(left) :], near[len(left) :, : len(left)] = between, between.T
            else:
                np.fill_diagonal(near, False)
            low = spanning(near)
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                out.append((ids[rows[k]], int(n[rows[near[k]]].sum()), ids[rows[low[k]]]))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, schema=schema)

    return members.groupBy("task").applyInArrow(run, "id long, links long, other long")


def judged(documents: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per row: id and key (what it is judged under), doc_id, class_id, component_id, links, and lead: whether it stands for its component.

    A component's lead is the (id, key) that is smallest in it; rows without words are leads of their own.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    signed = scratch.write(signatures(documents, threshold, words), "signatures")
    full = signed.where("class is not null")
    by_class = full.groupBy("class").agg(F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    by_class = scratch.write(by_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    first = by_class.select("node", "n", F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    met = by_class.select("node", F.explode(F.array_distinct("bands")).alias("band"))
    buckets = met.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    edges = met.join(buckets.select("band", "least"), "band").where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct()
    candidates = connected_components(edges, scratch, "candidates")
    members = candidates.join(first, "node").select("id", "key", "node", "n", F.col("component").alias("grp"))
    texts = documents.select(own_id().alias("id"), text_key().alias("key"), "text").join(members, ["id", "key"])
    texts = texts.groupBy("id", "key").agg(*(F.first(c).alias(c) for c in ("node", "n", "grp", "text")))
    sets = scratch.write(n_gram_sets(texts.select(F.col("node").alias("id"), "n", "grp", "text"), words).withColumn("weight", F.size("grams")), "sets")
    weight = sets.agg(F.sum("weight")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, weight // HEAVY)
    checked = scratch.write(verify(deal(sets, "grp", "id", weight="weight", tasks=tasks), threshold), "checked")
    scratch.drop("sets")
    groups = connected_components(checked.select(F.col("id").alias("src"), F.col("other").alias("dst")), scratch, "groups")
    links = checked.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    leads = groups.join(by_class.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("lead"))
    found = by_class.join(links, "node", "left").join(groups.join(leads, "component").select("node", "lead"), "node", "left")
    found = found.select("class", "first", F.coalesce("lead", "first").alias("lead"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = signed.select("id", "key", "doc_id", "class").join(found, "class", "left")
    return out.select(
        "id",
        "key",
        "doc_id",
        F.coalesce("first.id", "id").alias("class_id"),
        F.coalesce("lead.id", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce((F.col("lead.id") == F.col("id")) & (F.col("lead.key") == F.col("key")), F.lit(True)).alias("lead"),
        F.col("class").isNull().alias("bare"),
    )


def classes(documents: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, class_id (smallest id with the same n-gram set), component_id (smallest reachable id), n_links, kept.

    n_links counts the other rows linked directly, those of the same class included; kept: the row has its component's smallest id.
    """
    rows = judged(documents.select("doc_id", "text"), threshold, words)
    return rows.select("doc_id", "class_id", "component_id", F.col("links").alias("n_links"), (F.col("id") == F.col("component_id")).alias("kept"))


def representatives(documents: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of ``documents``, all their columns: of each component one, and all rows without words."""
    scratch = Scratch(documents.sparkSession, "kept")
    rows = judged(documents.select("doc_id", "text"), threshold, words).where("not bare")
    spare = lambda name: next(n for k in range(len(documents.columns) + 1) if (n := name + "_" * k) not in documents.columns)
    own, key, whole = spare("own_id"), spare("text_key"), spare("row")
    by_key = rows.groupBy("id", "key").agg(F.count("*").alias("n"), F.max("lead").alias("lead"))
    odd = scratch.write(by_key.where("n > 1 or not lead").select(F.col("id").alias(own), F.col("key").alias(key), "lead"), "odd")
    given = documents.withColumns({own: own_id(), key: text_key()})
    out = given.join(odd.select(own, key), [own, key], "left_anti").drop(own, key)
    again = odd.where("lead").select(own, key)
    if again.limit(1).count():
        hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in documents.schema if f.dataType.typeName() != "map"])
        of_equal = given.join(again, [own, key], "left_semi").groupBy(own, key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), hashed).alias(whole))
        out = out.unionByName(of_equal.select(f"{whole}.*"))
    return out
