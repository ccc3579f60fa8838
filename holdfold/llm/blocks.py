"""Comparing all members of a group without one task holding the group.

Groups are cut into chunks of about SIZE members, or fewer where members are heavy, and each
pair of chunks is a task of its own; small groups share tasks, as many as their weight asks
for.  A member is copied once per chunk of its group, and results leave a task as counts and
spanning edges, never as all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members, and their weight (numbers of 8 bytes), in a chunk.
SIZE, HEAVY = 1024, 1 << 21


def deal(members: DataFrame, group: str, member: str, size: int = SIZE, weight: str | None = None, tasks: int = 1) -> DataFrame:
    """``members`` with ``part`` (string, what to compare within), ``side`` and ``task`` (long, what to group by).

    Where a part pairs two chunks (:func:`crossing`), only members of different sides are compared.
    ``weight``: a column of the members' weights; ``tasks``: over how many tasks whole groups are spread.
    """
    heavy = F.ceil(F.sum(weight) / HEAVY) if weight else F.lit(1)
    sizes = members.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / size), heavy).cast("int").alias("_chunks"))
    rows = members.join(sizes, group)
    chunks = F.col("_chunks")
    chunk = F.pmod(F.xxhash64(F.lit(17), member), chunks).cast("int")
    pair = lambda k: F.struct(F.least(chunk, k).alias("a"), F.greatest(chunk, k).alias("b"), F.when(chunk <= k, 0).otherwise(1).alias("side"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side")))
    rows = rows.withColumn("_pair", F.explode(F.when(chunks <= 1, whole).otherwise(F.transform(F.sequence(F.lit(0), chunks - 1), pair))))
    part = F.concat_ws("/", F.col(group).cast("string"), F.col("_pair.a").cast("string"), F.col("_pair.b").cast("string"))
    own = F.xxhash64("part")
    task = F.when(chunks <= 1, F.pmod(own, F.lit(tasks))).otherwise(own)
    return rows.withColumns({"part": part, "side": F.col("_pair.side")}).withColumn("task", task).drop("_pair", "_chunks")


def crossing(part: str) -> bool:
    """Whether a part compares two different chunks, and so only members of different sides."""
    _, a, b = part.rsplit("/", 2)
    return a != b


def spanning(near: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: each member's smallest connected member."""
    n = len(near)
    label = np.arange(n, dtype=np.int32)
    reach = near | np.eye(n, dtype=bool)
    while True:
        low = np.where(reach, label[None, :], np.int32(n)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low
