"""Operators whose state passes from one period to the next; they run on ranked, small tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hysteresis(ranked: DataFrame, target: int = 25, buffer: int = 35, lag: int = 1) -> DataFrame:
    """(period, source, key, rank, status): members of a universe of ``target`` keys, judged on the ranks of ``lag`` periods before.

    Incumbents keep their places, best first, while they rank within ``buffer``; only places that
    are free then go to others, who must rank within ``target``.  A source period without ranks
    leaves the members as they are and gives no rows.  ``ranked`` has period, key and rank (null
    where a key isn't eligible); rows beyond ``buffer`` are dropped before the one grouped call,
    whose input is at most ``buffer`` rows a period.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        members: set = set()
        out = []
        by_period = {p: rows.dropna(subset=["rank"]).sort_values("rank") for p, rows in pdf.groupby("period", sort=True)}
        periods = list(by_period)
        for source, period in zip(periods, periods[lag:], strict=False):
            rank = dict(zip(by_period[source]["key"], by_period[source]["rank"], strict=True))
            if not rank:
                continue
            kept = sorted((k for k in members if rank.get(k, buffer + 1) <= buffer), key=rank.__getitem__)[:target]
            fresh = [k for k, r in rank.items() if r <= target and k not in kept][: target - len(kept)]
            out += [(period, source, k, float(rank[k]), "retained" if k in members else "new") for k in [*kept, *fresh]]
            members = {*kept, *fresh}
        return pd.DataFrame(out, columns=["period", "source", "key", "rank", "status"])

    every = ranked.select("period").distinct().select("period", F.lit(None).cast(dict(ranked.dtypes)["key"]).alias("key"), F.lit(None).cast("double").alias("rank"))
    slim = ranked.where(F.col("rank") <= buffer).select("period", "key", F.col("rank").cast("double").alias("rank")).union(every).withColumn("one", F.lit(1))
    types = dict(slim.dtypes)
    return slim.groupBy("one").applyInPandas(walk, f"period {types['period']}, source {types['period']}, key {types['key']}, rank double, status string")


def spaced(changes: DataFrame, gap: int = 20) -> DataFrame:
    """Rebalance numbers from candidate row numbers ``i``: each more than ``gap`` after the last one taken."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for i in sorted(pdf["i"]):
            if last is None or i - last > gap:
                out.append(i)
                last = i
        return pd.DataFrame({"i": out})

    return changes.select("i").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(walk, "i long")
