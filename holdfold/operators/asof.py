"""As-of and dated range joins, which SQL has no built-in form for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the latest row of ``right`` at or before it (before it: ``strict``).

    One shuffle by key: both sides are united and the last value seen is carried along the
    order of time, so that neither side is multiplied by the other's length.
    """
    values = list(values)
    held = F.struct(*values).alias("_held")
    rows = left.select(F.struct(*left.columns).alias("_row"), *by, F.col(on).alias("_at"), F.lit(0 if strict else 1).alias("_side"))
    marks = right.select(*by, F.col(on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), held)
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_seen", F.last("_held", ignorenulls=True).over(order))
    return both.where("_row is not null").select("_row.*", *[F.col(f"_seen.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, start: str, end: str, days: int = 90) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` whose [start, end] holds the date ``on``.

    Ranges are cut into buckets of ``days``, so that the join has an equality on the bucket
    and long histories of one key are spread over it.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    spread = right.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return left.withColumn("_bucket", bucket(F.col(on))).join(spread, [*by, "_bucket"]).where(F.col(on).between(F.col(start), F.col(end))).drop("_bucket")
