"""Iterative graph operators: groups by union-find, centrality by power iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_folder


def _checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder where the session has none yet."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def groups(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, group): each node's smallest connected node.

    Labels fall to the smallest of the neighbours', then jump to their label's label.
    Lineage is cut with checkpoint(); set a checkpoint folder that all executors share.
    """
    _checkpoints(edges.sparkSession)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().checkpoint()
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("group", F.col("node")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("group").alias("low"))
        lower = labels.join(near, "node").select("node", F.least("group", "low").alias("group"), F.col("group").alias("before"))
        jump = lower.select(F.col("node").alias("group"), F.col("group").alias("over"))
        new = lower.join(jump, "group", "left").select("node", F.least("group", F.coalesce("over", "group")).alias("group"), "before").checkpoint()
        changed = new.where(F.col("group") != F.col("before")).limit(1).count()
        labels = new.select("node", "group")
        if not changed:
            break
    return labels


def centrality(weights: DataFrame, rounds: int = 12, by: str | None = None) -> DataFrame:
    """([by,] row, centrality) of the overlap matrix XX' without its diagonal, by power iteration, all values of ``by`` at once.

    ``weights`` has row, item and w.  Each step is two aggregations of the sparse triples:
    t = X'v, then v = Xt - own * v; the matrix of pairs is never formed.
    """
    _checkpoints(weights.sparkSession)
    keys = [by] if by else []
    weights = weights.select(*keys, "row", "item", "w").checkpoint()
    own = weights.groupBy(*keys, "row").agg(F.sum(F.col("w") * F.col("w")).alias("own")).checkpoint()
    v = own.select(*keys, "row", F.lit(1.0).alias("v"))
    for _ in range(rounds):
        t = weights.join(v, [*keys, "row"]).groupBy(*keys, "item").agg(F.sum(F.col("w") * F.col("v")).alias("t"))
        u = weights.join(t, [*keys, "item"]).groupBy(*keys, "row").agg(F.sum(F.col("w") * F.col("t")).alias("u"))
        new = u.join(v, [*keys, "row"]).join(own, [*keys, "row"]).select(*keys, "row", (F.col("u") - F.col("own") * F.col("v")).alias("v")).checkpoint()
        norm = new.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        v = (new.join(norm, keys) if keys else new.crossJoin(F.broadcast(norm))).select(*keys, "row", F.coalesce(F.try_divide("v", "norm"), F.lit(0.0)).alias("v"))
    return v.withColumnRenamed("v", "centrality")
