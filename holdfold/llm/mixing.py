"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets: sources share TOTAL of all words by weight; a source's target stops at
MAX_EPOCHS times its size, and what is above goes to the others by weight until none is
above.  With the sources in the order of cap / weight this is one running sum: a source
is capped if its cap is at most its share of what the sources before it leave.

Sampling: every document is taken ``whole`` times, the whole part of target / size; the
rest of the target is a seeded sample of further documents.  A document's mark is a hash
of its id, text and source; a source takes the marks up to a cut such that the next would
overshoot, once more so (CUTS) of the remaining documents that still fit, and then, FILLS
times, the largest that still fits.  Equal rows share a mark and are told apart by their place in the table of sizes, so a
cut may go through them; as they are equal, the mixture is the same whichever are taken.
A cut is found from sums by histogram bucket of marks, then by mark, then by partition of
the table, then by place, so no source and no group of equal rows is gathered in one task.
Sizes are counted once and written, with the kept columns, as the table of sizes.

The table of sources is ordered in one task; it has one row per distinct source (some 50
bytes, and sorting spills).

Defined results: a null text has size 0; a null source is a source of its own, last in
the order; equal rows (id, text and source) are told apart by place alone; sources without
words have target 0 and nothing taken; an empty table gives an empty result.  Columns of the
input named like those added (size, source_size, target, copies, taken; repeat in
:func:`sample`) are replaced.  A text is counted where it lies and held once.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS, MAX_EPOCHS, TOTAL, SEED, CUTS, FILLS = (5, 2, 1), 3, 1.0, 11, 2, 1
_BUCKET_BITS = 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mark_of(seed: int) -> Column:
    """A non-negative 63-bit number of the row."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"), "source"), 1)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = MAX_EPOCHS, total: float = TOTAL) -> DataFrame:
    """``sizes`` (source, source_size) with sid (order of source, null last), weight, target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    listed = listed.withColumns({"weight": weight, "cap": F.col("source_size") * float(epochs)})
    everything = Window.partitionBy()
    listed = listed.withColumns({"_all": F.sum("source_size").over(everything) * float(total), "_weights": F.sum("weight").over(everything)})
    level = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumns({"_caps": F.coalesce(F.sum("cap").over(level), F.lit(0.0)), "_done": F.coalesce(F.sum("weight").over(level), F.lit(0.0))})
    rate = (F.col("_all") - F.col("_caps")) / (F.col("_weights") - F.col("_done"))
    capped = F.col("cap") <= F.col("weight") * rate
    listed = listed.withColumns({"_capped": capped, "_rate": F.min(F.when(~capped, F.struct(F.col("cap") / F.col("weight"), F.col("sid"), rate.alias("rate")))).over(everything)["rate"]})
    target = F.when(F.col("_capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("_rate")))
    return listed.select("sid", "source", "source_size", "weight", target.alias("target"))


def _edge(sums: DataFrame, want: DataFrame, by: str) -> DataFrame:
    """``sums`` (sid, by, n) added up in the order of ``by``, against ``want`` (sid, left): per sid, last: up to where the sum stays within; next (by, left): what comes next, and what is left for it."""
    upto = Window.partitionBy("sid").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    total = sums.withColumn("total", F.sum("n").over(upto)).join(want, "sid")
    after = F.struct(by, (F.col("left") - (F.col("total") - F.col("n"))).alias("left"))
    return total.groupBy("sid").agg(F.max(F.when(F.col("total") <= F.col("left"), F.col(by))).alias("last"), F.min(F.when(F.col("total") > F.col("left"), after)).alias("next"))


def _cuts(marks: DataFrame, want: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, cut): the largest (mark, place) up to which the sums of ``marks`` (sid, mark, place, size) stay within ``want`` (sid, left)."""
    marks = marks.withColumns({"bucket": F.shiftright("mark", 63 - _BUCKET_BITS), "part": F.shiftright("place", 33)})
    most = F.lit((1 << 63) - 1)
    cut = lambda mark, place: F.struct(mark.alias("mark"), place.alias("place")).alias("cut")
    following = lambda edge, by: edge.where("next is not null").select("sid", f"next.{by}", "next.left")
    buckets = scratch.write(_edge(marks.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), want, "bucket"), "edge-bucket")
    edge = following(buckets, "bucket")
    inside = marks.join(edge.drop("left"), ["sid", "bucket"])
    by_mark = scratch.write(_edge(inside.groupBy("sid", "mark").agg(F.sum("size").alias("n")), edge.drop("bucket"), "mark"), "edge-mark")
    found = [
        buckets.where("last is not null").select("sid", cut(F.shiftleft(F.col("last") + 1, 63 - _BUCKET_BITS) - 1, most)),
        by_mark.where("last is not null").select("sid", cut(F.col("last"), most)),
    ]
    tied = following(by_mark, "mark")
    equal = scratch.write(inside.join(tied, ["sid", "mark"]).where("size <= left").select("sid", "mark", "part", "place", "size"), "edge-equal")
    if equal.limit(1).count():
        by_part = scratch.write(_edge(equal.groupBy("sid", "part").agg(F.sum("size").alias("n")), tied.drop("mark"), "part"), "edge-part")
        last = following(by_part, "part")
        rows = _edge(equal.join(last.drop("left"), ["sid", "part"]).select("sid", "place", F.col("size").alias("n")), last.drop("part"), "place")
        mark = tied.select("sid", "mark")
        found.append(by_part.where("last is not null").join(mark, "sid").select("sid", cut(F.col("mark"), F.shiftleft(F.col("last") + 1, 33) - 1)))
        found.append(rows.where("last is not null").join(mark, "sid").select("sid", cut(F.col("mark"), F.col("last"))))
    return functools.reduce(DataFrame.union, found).groupBy("sid").agg(F.max("cut").alias("cut"))


_CUT = "array<struct<limit:double,mark:bigint,place:bigint>>"
_FILL = "array<struct<mark:bigint,place:bigint>>"


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = MAX_EPOCHS, total: float = TOTAL, scratch: Scratch | None = None) -> DataFrame:
    """Of ``rows`` (source, size, mark, place), one row per source: source, source_size, target, whole, cuts, an array of the last (mark, place) sampled of rows up to a limit, and fills, an array of single ones."""
    scratch = scratch or Scratch(rows.sparkSession, "mixing")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs, total)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    left = F.col("target") - F.col("whole") * F.col("source_size") + 1e-6
    sources = scratch.write(sources.withColumn("whole", whole).withColumns({"left": left, "cuts": F.array().cast(_CUT), "fills": F.array().cast(_FILL)}), "sources")
    slim = sources.select("sid", "left", F.col("source").alias("_source"))
    near = rows.select("source", "size", "mark", "place").join(slim, F.col("source").eqNullSafe(F.col("_source"))).where("size > 0 and size <= left")
    marks = scratch.write(near.select("sid", "size", "mark", "place"), "marks")
    state = sources.select("sid", "left", "cuts", "fills")
    place = F.struct("mark", "place")
    for k in range(CUTS + FILLS):
        fits = marks.join(state, "sid").where((F.col("size") <= F.col("left")) & ~extra())
        if k < CUTS:
            found = scratch.write(_cuts(fits.select("sid", "mark", "place", "size"), state.select("sid", "left"), scratch), f"found-{k}")
            took = fits.join(found, "sid").where(place <= F.col("cut")).groupBy("sid").agg(F.sum("size").alias("took"))
            joined = state.join(found, "sid", "left").join(took, "sid", "left")
            added = F.when(F.col("cut").isNotNull(), F.array(F.struct(F.col("left").alias("limit"), "cut.mark", "cut.place"))).otherwise(F.array().cast(_CUT))
            state = joined.select("sid", (F.col("left") - F.coalesce("took", F.lit(0))).alias("left"), F.concat("cuts", added).alias("cuts"), "fills")
        else:
            joined = state.join(fits.groupBy("sid").agg(F.max(F.struct("size", "mark", "place")).alias("best")), "sid", "left")
            added = F.when(F.col("best").isNotNull(), F.array(F.struct("best.mark", "best.place"))).otherwise(F.array().cast(_FILL))
            state = joined.select("sid", (F.col("left") - F.coalesce("best.size", F.lit(0))).alias("left"), "cuts", F.concat("fills", added).alias("fills"))
        state = scratch.write(state, f"state-{k}")
    out = scratch.write(sources.drop("left", "cuts", "fills").join(state.drop("left"), "sid"), "plan")  # a small file, so that its size is known
    for table in ("marks", "sources", "edge-bucket", "edge-mark", "edge-equal", "edge-part", *(f"found-{k}" for k in range(CUTS)), *(f"state-{k}" for k in range(CUTS + FILLS))):
        scratch.drop(table)
    return out


def extra() -> Column:
    """Whether a row with ``size``, ``mark`` and ``place`` is sampled by its source's ``cuts`` or ``fills``."""
    cut = F.exists("cuts", lambda c: (F.col("size") <= c["limit"]) & ((F.col("mark") < c["mark"]) | ((F.col("mark") == c["mark"]) & (F.col("place") <= c["place"]))))
    return (F.col("size") > 0) & (cut | F.exists("fills", lambda c: (F.col("mark") == c["mark"]) & (F.col("place") == c["place"])))


ADDED = ("size", "source_size", "target", "copies", "taken")


def mixed(documents: DataFrame, seed: int = SEED, keep: Sequence[str] | None = None, **given) -> DataFrame:
    """``documents``, all their columns or those of ``keep``, with size, source_size, target, copies and taken (words)."""
    scratch = Scratch(documents.sparkSession, "mixing")
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ADDED]
    sized = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "source", size_of(F.col("text")).alias("size"), mark_of(seed).alias("mark"), F.monotonically_increasing_id().alias("place"))
    rows = scratch.write(sized, "sizes")
    sources = plan(rows, scratch=scratch, **given).select(F.col("source").alias("_source"), "source_size", "target", "whole", "cuts", "fills")
    found = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", F.col("whole") + extra().cast("long"))
    return found.withColumn("taken", F.col("size") * F.col("copies")).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *ADDED)


def sample(documents: DataFrame, **given) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with ``taken`` and with ``repeat`` from 1."""
    names = [c for c in documents.columns if c not in ("taken", "repeat")]
    rows = mixed(documents.select(*[F.col(f"`{c}`") for c in names]).withColumn("_given", F.struct(*[F.col(f"`{c}`") for c in names])), keep=["_given"], **given).where("copies > 0")
    return rows.select(*[F.col(f"_given.`{c}`").alias(c) for c in names], "taken", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("repeat"))
