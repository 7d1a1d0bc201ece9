"""File events as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators import events as E


def _sorted_batch(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of a trigger in time order; the trigger size bounds them."""
    return pd.concat(list(batches)).sort_values(["ts_ms", "event_id"], kind="stable")


def dedup_stream(events: DataFrame, late: str, window_ms: int = E.DEDUP_MS) -> DataFrame:
    """Add events without repeats of a path within the window of the last kept one.

    The state per path is one time stamp.  It is dropped once the watermark,
    ``late`` behind the newest event, is ten windows past it.  Events older
    than the watermark are dropped: choose ``late`` so that none are.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _sorted_batch(batches)
        keep = []
        for t in rows["ts_ms"]:
            fresh = last is None or t - last >= window_ms
            keep.append(fresh)
            last = int(t) if fresh else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 10 * window_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, ["event_id", "path", "ts_ms"]]

    return (
        events.filter(F.col("op") == "add")
        .select("event_id", "path", "ts_ms", F.timestamp_millis("ts_ms").alias("at"))
        .withWatermark("at", late)
        .groupBy("path")
        .applyInPandasWithState(
            step, "event_id long, path string, ts_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def rate_limit_stream(
    events: DataFrame, key: str, late: str, limit: int = E.RATE_PER_SECOND, window_ms: int = E.RATE_WINDOW_MS
) -> DataFrame:
    """First ``limit`` events of each window of a watcher; ``key`` tells watchers apart.

    The state is the window start and a count, and expires like that of
    ``dedup_stream``; events older than the watermark are dropped likewise.
    """
    shape = f"{key} string, event_id long, path string, ts_ms long"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = _sorted_batch(batches)
        keep = []
        for t in rows["ts_ms"]:
            if start is None or t - start >= window_ms:
                start, count = int(t), 0
            count += 1
            keep.append(count <= limit)
        state.update((start, count))
        state.setTimeoutTimestamp(max(start + 10 * window_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, [key, "event_id", "path", "ts_ms"]]

    return (
        events.select(key, "event_id", "path", "ts_ms", F.timestamp_millis("ts_ms").alias("at"))
        .withWatermark("at", late)
        .groupBy(key)
        .applyInPandasWithState(step, shape, "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def debounce_stream(events: DataFrame, key: str, late: str, quiet_ms: int = E.DEBOUNCE_MS) -> DataFrame:
    """Last event of every burst, once the burst is over; events later than ``late`` are dropped."""
    stamped = events.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    session = F.session_window("at", f"{quiet_ms} milliseconds")
    bursts = stamped.groupBy(key, session.alias("burst")).agg(F.max(F.struct("ts_ms", "event_id")).alias("last"))
    return bursts.select(key, "last.ts_ms", "last.event_id")


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events per tumbling window and kind; events later than ``late`` are dropped."""
    stamped = events.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width).alias("w"), "op").agg(F.count(F.lit(1)).alias("n"))


def start(
    stream: DataFrame, handle: Callable[[DataFrame, int], Any], checkpoint: str, interval: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch; without an interval, drain what is there and stop."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def index_arrivals(
    add: Callable[[DataFrame], None], extract: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Micro-batch handler that hands new files to ``add``.

    ``extract`` turns scanned files into (path, text).  ``add`` must leave
    known paths alone, so that a batch may run again.
    """

    def handle(batch: DataFrame, _: int) -> None:
        texts = extract(batch).select("path", F.col("text").alias("text_content"))
        named = batch.select("path", "file_name").join(texts, "path", "left")
        add(named.select(F.col("path").alias("file_path"), "file_name", "text_content"))

    return handle


def reconcile_periodically(
    ticks: DataFrame, reconcile: Callable[[], Any], checkpoint: str, interval: str = "60 seconds"
) -> StreamingQuery:
    """Compare index and folder on every tick of a stream.

    ``reconcile`` brings all relations of the index up to date, not files alone.
    """

    def handle(batch: DataFrame, _: int) -> None:
        reconcile()

    return start(ticks, handle, checkpoint, interval)
