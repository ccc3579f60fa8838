"""Algebra of portfolios in long form: date, name, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(weights: DataFrame, kind: str = "long") -> DataFrame:
    """Weights of each date over its long side (``long``), each side over its own (``split``), or with the short side brought to the long one's size (``equalize``)."""
    day = Window.partitionBy("date")
    long, short = (F.sum(F.greatest(sign * F.col("weight"), F.lit(0.0))).over(day) for sign in (1, -1))
    w = F.col("weight")
    new = {
        "long": F.try_divide(w, long),
        "split": F.when(w >= 0, F.coalesce(F.try_divide(w, long), F.lit(0.0))).otherwise(F.try_divide(w, short)),
        "equalize": F.when(w >= 0, w).otherwise(w * F.coalesce(F.try_divide(long, short), F.lit(0.0))),
    }
    if kind not in new:
        raise ValueError(f"no normalisation {kind}")
    return weights.withColumn("weight", new[kind])


def scaled(weights: DataFrame, by: float) -> DataFrame:
    return weights.withColumn("weight", F.col("weight") * by)


def added(*portfolios: DataFrame) -> DataFrame:
    """The sum of portfolios, names that one lacks counting as zero there."""
    out = portfolios[0].select("date", "name", "weight")
    for p in portfolios[1:]:
        out = out.unionByName(p.select("date", "name", "weight"))
    return out.groupBy("date", "name").agg(F.sum("weight").alias("weight"))


def masked(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights of names in the universe (date, name); zero for the others."""
    inside = universe.select("date", "name").distinct().withColumn("_in", F.lit(True))
    return weights.join(inside, ["date", "name"], "left").withColumn("weight", F.when(F.coalesce("_in", F.lit(False)), F.col("weight")).otherwise(0.0)).drop("_in")


def agreeing(members: DataFrame, share: float) -> DataFrame:
    """``members`` (member, date, name, weight) with positions set to zero where fewer than ``share`` of all members are on that side."""
    if share <= 0:
        return members
    total = members.agg(F.countDistinct("member").alias("_n"))
    need = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    counts = members.groupBy("date", "name").agg(F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).alias("_long"), F.sum(F.when(F.col("weight") < 0, 1).otherwise(0)).alias("_short"))
    rows = members.join(counts, ["date", "name"]).crossJoin(F.broadcast(total))
    keep = ((F.col("weight") > 0) & (F.col("_long") >= need)) | ((F.col("weight") < 0) & (F.col("_short") >= need))
    return rows.withColumn("weight", F.when(keep, F.col("weight")).otherwise(0.0)).select(*members.columns)


def period_returns(weights: DataFrame, returns: DataFrame, borrow: DataFrame | None = None, cash: DataFrame | None = None, fee: float = 0.0) -> DataFrame:
    """(date, gross, cost, cash, net) of weights held over each date: names' returns, the borrowing rate on shorts, a fee on what is traded against the date before, and the cash rate on what isn't invested.

    ``returns``: date, name, ret; ``borrow``: date, name, rate; ``cash``: date, rate.  Missing returns and rates are zero.
    """
    rows = weights.join(returns, ["date", "name"], "left")
    if borrow is not None:
        rows = rows.join(borrow.select("date", "name", F.col("rate").alias("_rate")), ["date", "name"], "left")
    rate = F.coalesce("_rate", F.lit(0.0)) if borrow is not None else F.lit(0.0)
    dates = weights.select("date").distinct()
    following = dates.withColumn("_next", F.lead("date").over(Window.orderBy("date")))
    carried = weights.join(following, "date").where("_next is not null").select(F.col("_next").alias("date"), "name", (-F.col("weight")).alias("d"))
    traded = weights.select("date", "name", F.col("weight").alias("d")).unionByName(carried).groupBy("date", "name").agg(F.sum("d").alias("d")).groupBy("date").agg(F.sum(F.abs("d")).alias("_traded"))
    sums = rows.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum(F.greatest(-F.col("weight"), F.lit(0.0)) * rate).alias("_borrow"), F.sum("weight").alias("_net"))
    out = sums.join(traded, "date")
    out = out.join(cash.select("date", F.col("rate").alias("_cash")), "date", "left") if cash is not None else out.withColumn("_cash", F.lit(0.0))
    cost, idle = F.col("_borrow") + F.col("_traded") * fee, (1 - F.col("_net")) * F.coalesce("_cash", F.lit(0.0))
    return out.select("date", "gross", cost.alias("cost"), idle.alias("cash"), (F.col("gross") - cost + idle).alias("net"))
