"""What was knowable when: versions of filings folded as of a date.

``revisions``: accession, cik, filer_id, period_end, kind (null or ORIGINAL, RESTATEMENT, NEW
HOLDINGS), known, and amendment_no where there is one.  ``holdings``: accession, instrument,
shares, value.  A version is ordered by when it was known, then by its number, those without
one first, then by accession.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ADDS = "NEW HOLDINGS"


def versions(revisions: DataFrame, by: tuple[str, ...] = ("cik", "period_end")) -> DataFrame:
    """``revisions`` with ``seq``, from 0."""
    number = F.col("amendment_no") if "amendment_no" in revisions.columns else F.lit(None).cast("double")
    order = [F.col("known").asc(), number.asc_nulls_first(), F.col("accession").asc()]
    return revisions.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def live(revisions: DataFrame, day, by: tuple[str, ...] = ("cik", "period_end"), strict: bool = False) -> DataFrame:
    """The versions that make the book known on ``day`` (a date or a column): the last that replaces, and additions after it.

    Additions without anything that replaces stand alone, or, ``strict``, not at all.
    """
    seen = versions(revisions.where(F.col("known") <= (F.lit(day) if isinstance(day, str) else day)), by)
    adds = F.coalesce(F.upper(F.trim("kind")) == ADDS, F.lit(False))
    base = F.max(F.when(~adds, F.col("seq"))).over(Window.partitionBy(*by))
    kept = seen.withColumn("_base", base).where((F.col("seq") >= F.col("_base")) | (F.lit(not strict) & F.col("_base").isNull()))
    return kept.drop("_base")


def as_of(holdings: DataFrame, revisions: DataFrame, day, by: tuple[str, ...] = ("cik", "period_end")) -> DataFrame:
    """(by, instrument, shares, value) known on ``day``; of an instrument that several live versions hold, the newest version's rows count."""
    rows = live(revisions, day, by).join(holdings, "accession")
    last = rows.groupBy(*by, "instrument").agg(F.max("seq").alias("_last"))
    rows = rows.join(last, [*by, "instrument"]).where("seq = _last")
    return rows.groupBy(*by, "instrument").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"))


def strict_panel(holdings: DataFrame, revisions: DataFrame, day) -> DataFrame:
    """(filer_id, period_end, instrument, shares, value, available): live versions per cik, additions only after a base, summed to filers; available from when the last of them was known."""
    rows = live(revisions, day, strict=True)
    rows = rows.withColumn("available", F.max("known").over(Window.partitionBy("filer_id", "period_end"))).join(holdings, "accession")
    return rows.groupBy("filer_id", "period_end", "instrument").agg(F.sum("shares").alias("shares"), F.sum("value").alias("value"), F.max("available").alias("available"))
