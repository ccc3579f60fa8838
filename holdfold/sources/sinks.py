"""Sinks: compressed CSV, the curated layer, and signal panels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, compressed where the path ends so; nested columns are written as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    flat = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else df
    flat.write.mode("overwrite").option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)


def save_curated(folder: str, tables: Mapping[str, DataFrame], rejections: DataFrame | None = None, by: Mapping[str, str] | None = None) -> None:
    """The curated layer: each table as Parquet under its name, partitioned where ``by`` says, and the counts of rejected rows as JSON lines."""
    for name, df in tables.items():
        column = (by or {}).get(name)
        rows = df.hint("rebalance", column) if column else df
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(column) if column else writer).parquet(f"{folder}/{name}")
    if rejections is not None:
        rejections.coalesce(1).write.mode("overwrite").json(f"{folder}/rejections")


def save_panel(signal: DataFrame, calendar: DataFrame, path: str, limit: int = 75) -> None:
    """A signal (instrument, day, value) as a step function over ``calendar`` (day), each value carried on for ``limit`` days of it at most, by month.

    Days are numbered once; a value meets the days that it holds for by an equality on blocks of
    ``limit`` numbers, so neither a grid of all names and days nor a range join is formed.
    """
    order = Window.orderBy("day")
    days = calendar.select("day").distinct().withColumn("i", F.row_number().over(order))
    stamped = signal.select("instrument", "day", "value").where("value is not null")
    ahead = stamped.select("day").distinct().join(days, "day", "full_outer")
    ahead = ahead.select("day", F.first("i", True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("i"))
    begun = stamped.join(ahead.where("i is not null"), "day").groupBy("instrument", "i").agg(F.max_by("value", "day").alias("value"))
    following = F.lead("i").over(Window.partitionBy("instrument").orderBy("i"))
    spans = begun.withColumn("end", F.least(F.coalesce(following, F.col("i") + limit + 1), F.col("i") + limit + 1))
    blocks = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / limit), F.floor((F.col("end") - 1) / limit))))
    held = blocks.join(days.select("day", F.col("i").alias("at"), F.floor(F.col("i") / limit).alias("block")), "block").where("at >= i and at < end")
    held.select("day", "instrument", "value", F.date_format("day", "yyyy-MM").alias("month")).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
