"""Transforms within groups of rows, as column expressions over windows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct_rank(value: Column, by: Sequence[str]) -> Column:
    """Average rank over the number of non-null values; null for null."""
    group = Window.partitionBy(*by, value.isNull())
    ties = Window.partitionBy(*by, value)
    rank = F.rank().over(group.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2
    return F.when(value.isNotNull(), rank / F.count(value).over(group))


def quantile_bin(value: Column, tie: Column, by: Sequence[str], k: int) -> Column:
    """Bin from 0 to k - 1 by order of value, in integers; ties by ``tie``."""
    group = Window.partitionBy(*by)
    n, rn = F.count(F.lit(1)).over(group), F.row_number().over(group.orderBy(value, tie))
    return F.when(n > 1, F.greatest(F.floor(((rn - 1) * k + n - 2) / (n - 1)), F.lit(1)) - 1).otherwise(0)


def winsorise(value: Column, by: Sequence[str], p: float = 0.01) -> Column:
    group = Window.partitionBy(*by)
    low, high = (F.percentile(value, q).over(group) for q in (p, 1 - p))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def zscore(value: Column, by: Sequence[str], sample: bool = False) -> Column:
    group = Window.partitionBy(*by)
    spread = (F.stddev_samp if sample else F.stddev_pop)(value).over(group)
    return F.try_divide(value - F.avg(value).over(group), spread)


def _safe(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """Join condition on groups, null groups meeting each other; the right side's columns have a bar before them."""
    return [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]


def residual(df: DataFrame, y: str, x: str, by: Sequence[str], out: str = "residual") -> DataFrame:
    """``df`` with y less its least-squares line on x within each group; demeaned y where x doesn't vary.

    A group's moments are summed where its rows lie and joined back, so no group is gathered.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    of_x = F.when(F.col(y).isNotNull(), F.col(x))
    moments = df.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(
        F.avg(y).alias("_my"), F.avg(of_x).alias("_mx"), F.coalesce(F.try_divide(F.covar_pop(F.when(both, F.col(y)), F.when(both, F.col(x))), F.var_pop(of_x)), F.lit(0.0)).alias("_slope")
    )
    joined = df.join(moments, functools.reduce(lambda a, b: a & b, _safe(df, by)))
    return joined.withColumn(out, F.col(y) - F.col("_my") - F.col("_slope") * (F.col(x) - F.col("_mx"))).select(*df.columns, out)


def ranked(df: DataFrame, value: str, by: Sequence[str], tie: Sequence[str], store: Callable[[DataFrame], DataFrame], parts: int | None = None) -> DataFrame:
    """``df`` with, of the rows of its group whose value isn't null, ``rank`` (average rank over their number), ``place`` (row number by value, then ``tie``) and ``size`` (their number); rows with a null value have nulls.

    Rows are dealt into ranges of (group, value), so a group spreads over as many tasks as its
    share of the rows asks for, and equal values meet in one; ranks within a range are moved on by
    the numbers of rows in the ranges before it.  ``store`` writes a table and reads it again, so
    that ranges stay what they are.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(df.where(F.col(value).isNotNull()).repartitionByRange(parts, *by, value).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy(*by))})
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), "_before", "size")
    here = Window.partitionBy(*by, "_range")
    on = functools.reduce(lambda a, b: a & b, [*_safe(df, by), F.col("_range") == F.col("_at")])
    rows = dealt.join(counts, on)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "_range", value))
    rank = (F.col("_before") + F.rank().over(here.orderBy(value)) + (ties - 1) / 2) / F.col("size")
    place = F.col("_before") + F.row_number().over(here.orderBy(value, *tie))
    rows = rows.withColumns({"rank": rank, "place": place}).select(*df.columns, "rank", "place", "size")
    without = df.where(F.col(value).isNull()).select(*df.columns, F.lit(None).cast("double").alias("rank"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("size"))
    return rows.unionByName(without)
