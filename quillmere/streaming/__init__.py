"""Structured Streaming counterparts: event-time windows, live metrics, memory, deduplication, index sync.

Every function takes a streaming (or batch) DataFrame, so that the same plan is tested on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.buckets import BucketTable
from ..operators.state import latest
from .stateful import memory, workflow_sessions

__all__ = ["deduplicated", "event_time", "idempotent", "live_counters", "memory", "sessions", "sync_files", "windowed", "workflow_sessions"]


def event_time(events: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Events with a proper timestamp (a zone-less one is taken as UTC) and a watermark."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    return e.withWatermark(at, delay) if e.isStreaming else e


def windowed(events: DataFrame, size: str, slide: str | None = None, at: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Count and sum in tumbling windows, or in sliding ones if ``slide`` is given."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, at: str = "ts", key: str = "user_id") -> DataFrame:
    """Session windows of each key."""
    g = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each key, within the watermark when streaming."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def live_counters(requests: DataFrame, keys: tuple[str, ...] = ("route", "status_class")) -> DataFrame:
    """Running request counts and duration sums; for update or complete mode."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum("duration").alias("duration_sum"))


def idempotent(attempts: DataFrame) -> DataFrame:
    """The first attempt of each idempotency key within the watermark."""
    return deduplicated(attempts, ["idempotency_key"])


def sync_files(stream: DataFrame, table: BucketTable, checkpoint: str, deleted: str | None = None, order: str | None = None):
    """Each micro-batch of changed rows goes into ``table`` exactly once: its number is committed with the
    rows, so that a batch which is played again after a crash changes nothing. Of several rows of a key
    in a batch the one of the highest ``order`` counts; rows whose ``deleted`` column holds delete their key."""

    def each(batch: DataFrame, number: int) -> None:
        if order is not None:
            batch = latest(batch, [table.key], order)
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        table.apply(batch.where(~gone), batch.where(gone), batch=number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
