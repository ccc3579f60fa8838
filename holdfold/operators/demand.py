"""Demand for funds in order of arrival, ownership, and what it passes on to the names in their baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arrivals(demand: DataFrame) -> DataFrame:
    """``demand`` (period_end, fund, available, delta) with ``running``: the demand known by then, ties in time together."""
    order = Window.partitionBy("period_end", "fund").orderBy("available").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return demand.withColumn("running", F.sum("delta").over(order))


def ownership_change(state: DataFrame, reference: DataFrame) -> DataFrame:
    """(period_end, fund, own, d_own): shares held over shares outstanding, and its change against the fund's period before."""
    held = state.groupBy("period_end", "fund").agg(F.sum("shares").alias("_held"))
    own = held.join(reference, ["period_end", "fund"]).select("period_end", "fund", F.try_divide("_held", "outstanding").alias("own"))
    return own.withColumn("d_own", F.col("own") - F.lag("own").over(Window.partitionBy("fund").orderBy("period_end")))


def look_through(demand: DataFrame, basket: DataFrame, stocks: DataFrame) -> DataFrame:
    """(period_end, name, pressure): the funds' ownership change times assets, by basket weight, over the name's cap.

    ``demand``: period_end, fund, d_own, assets; ``basket``: period_end, effective, fund, name,
    weight; ``stocks``: period_end, name, cap.  A basket that takes effect after its period's end
    wasn't knowable there, and raises where the result is computed.
    """
    late = F.raise_error(F.concat(F.lit("basket of "), F.col("fund").cast("string"), F.lit(" takes effect after "), F.col("period_end").cast("string")))
    checked = basket.withColumn("weight", F.when(F.col("effective") > F.col("period_end"), late.cast("double")).otherwise(F.col("weight")))
    flow = checked.join(demand, ["period_end", "fund"]).groupBy("period_end", "name").agg(F.sum(F.col("d_own") * F.col("assets") * F.col("weight")).alias("_flow"))
    return flow.join(stocks, ["period_end", "name"]).select("period_end", "name", F.try_divide("_flow", "cap").alias("pressure"))
