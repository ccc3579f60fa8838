"""Streams: windows over events, and filings folded in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; streaming or batch."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(span, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), "user_id", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


FOLD = "filer_id long, period string, version int, kind string, book double"


def fold_filings(arrivals: DataFrame) -> DataFrame:
    """Each filing's effect on its filer's book of a period, in order of arrival.

    ``arrivals``: filer_id, period (string), seq, kind, value.  An original or restatement
    replaces the book, new holdings add to it.  State never expires: amendments may come
    years later, and a watermark would drop them.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, added, version = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for kind, value in zip(rows["kind"], rows["value"], strict=True):
            version += 1
            if kind == "NEW HOLDINGS":
                added += value
            else:
                base, added = value, 0.0
            out.append((key[0], key[1], version, kind, base + added))
        state.update((base, added, version))
        yield pd.DataFrame(out, columns=["filer_id", "period", "version", "kind", "book"])

    return arrivals.groupBy("filer_id", "period").applyInPandasWithState(fold, FOLD, "base double, added double, version int", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is available into Parquet, and ends."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drained_whole(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream in complete mode over all that is available, and ends; the executors write each result over the last one."""

    def put(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


EXPIRING = "user_id long, event_id long, seen long, stale boolean"


def expiring(events: DataFrame, limit: str = "200 days") -> DataFrame:
    """Each event's number within its user's state, which lapses when the event before is more than ``limit`` old; ``stale``: a state had lapsed before it.

    Within a batch the events' own times decide; between batches a time-out on the watermark
    drops what nothing has touched, so state doesn't grow with users long gone.
    """
    width = pd.Timedelta(limit)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, _, lives = state.get
            state.update((last, 0, lives))  # the next event begins anew; what stays is three numbers
            return
        last, seen, lives = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, ts in zip(rows["event_id"], rows["ts"], strict=True):
            fresh = last is None or ts - pd.Timestamp(last, unit="us") > width
            seen, lives = (1, lives + 1) if fresh else (seen + 1, lives)
            out.append((key[0], event, seen, bool(fresh and lives > 1)))
            last = int(ts.value // 1000)
        state.update((last, seen, lives))
        state.setTimeoutTimestamp(last // 1000 + int(width.total_seconds() * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "seen", "stale"])

    rows = events.withWatermark("ts", limit).select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(fold, EXPIRING, "last long, seen long, lives long", "append", GroupStateTimeout.EventTimeTimeout)
