"""Calendar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def known_on(accepted_utc: Column, zone: str = "America/New_York", closing: int = 16) -> Column:
    """Local date of an acceptance time in UTC, the next one from the closing hour on."""
    local = F.from_utc_timestamp(accepted_utc, zone)
    return F.date_add(F.to_date(local), F.when(F.hour(local) >= closing, 1).otherwise(0))


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarters_between(spark: SparkSession, first: str, last: str, pad: int = 0) -> DataFrame:
    """(quarter_end, label) from the quarter of ``first`` to that of ``last``, widened by ``pad`` quarters."""
    days = F.sequence(F.add_months(F.trunc(F.lit(first).cast("date"), "quarter"), -3 * pad), F.add_months(F.trunc(F.lit(last).cast("date"), "quarter"), 3 * pad), F.expr("interval 3 months"))
    return spark.range(1).select(F.explode(days).alias("start")).select(quarter_end(F.col("start")).alias("quarter_end"), quarter_label(F.col("start")).alias("label"))


def roll_weekend(day: Column) -> Column:
    """Saturday and Sunday move to Monday."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))


def parse_day(text: Column, pattern: str = "dd-MMM-yyyy") -> Column:
    """A date, null where the text isn't one."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.lower(F.trim(text))), F.lit(pattern)))
