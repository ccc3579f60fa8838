"""Connected components by randomised contraction, in DataFrame operations only.

Every round relabels the vertices by a bijection drawn for that round, sends each
vertex to the smallest label among itself and its neighbours, and contracts.  The
number of vertices falls by a constant factor a round in expectation, whatever the
diameter.  A hub costs nothing special: minima are combined before the shuffle, and
the joins are plain inner joins whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _turn(c: Column, mask: int, k: int) -> Column:
    x = c.bitwiseXOR(F.lit(mask))
    return F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def _unturn(c: Column, mask: int, k: int) -> Column:
    x = F.shiftrightunsigned(c, k).bitwiseOR(F.shiftleft(c, 64 - k))
    return x.bitwiseXOR(F.lit(mask))


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", seed: int = 42) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    ``edges`` has long columns ``src`` and ``dst``, in either direction, repeats and
    loops allowed; rows with a null end are ignored, and nodes without an edge to
    another node aren't returned.  An empty table gives an empty result.
    """
    rng = random.Random(seed)
    links = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    links = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = scratch.write(links, f"{name}-links-0")
    maps: list[DataFrame] = []
    rounds = 0
    while links.limit(1).count():
        mask, k = rng.getrandbits(64) - (1 << 63), rng.randrange(1, 64)
        up = links.groupBy("src").agg(F.min(_turn(F.col("dst"), mask, k)).alias("m"))
        up = up.select(F.col("src").alias("v"), _unturn(F.least("m", _turn(F.col("src"), mask, k)), mask, k).alias("r"))
        up = scratch.write(up, f"{name}-map-{rounds}")
        maps.append(up)
        a = up.select(F.col("v").alias("src"), F.col("r").alias("a"))
        b = up.select(F.col("v").alias("dst"), F.col("r").alias("b"))
        new = links.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        new = scratch.write(new, f"{name}-links-{rounds + 1}")
        scratch.drop(f"{name}-links-{rounds}")
        links = new
        rounds += 1
        if rounds > 200:
            raise RuntimeError("contraction doesn't end")
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    top = maps[-1]
    for up in reversed(maps[:-1]):
        high = top.select(F.col("v").alias("r"), F.col("r").alias("t"))
        top = up.join(high, "r", "left").select("v", F.coalesce("t", "r").alias("r"))
    top = scratch.write(top, f"{name}-top")
    low = top.groupBy("r").agg(F.min("v").alias("component"))
    out = top.join(low, "r").select(F.col("v").alias("node"), "component")
    out = scratch.write(out, f"{name}-out")
    for k in range(rounds):
        scratch.drop(f"{name}-map-{k}")
    scratch.drop(f"{name}-links-{rounds}")
    scratch.drop(f"{name}-top")
    return out
