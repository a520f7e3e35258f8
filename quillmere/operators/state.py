"""Keyed state as tables: conversation memory, revisions, checkpoints, point lookups, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def message_id(session: Column, turn: Column, role: Column) -> Column:
    joined = F.concat(session.cast("string").cast("binary"), F.lit(b"\x00"), turn.cast("string").cast("binary"), F.lit(b"\x00"), role.cast("binary"))
    return F.concat(F.lit("memory-"), F.substring(F.sha2(joined, 256), 1, 24))


def next_turn(messages: DataFrame, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """session, next_turn = highest turn + 1."""
    return messages.groupBy(session).agg((F.coalesce(F.max(turn), F.lit(0)) + 1).alias("next_turn"))


def retained(messages: DataFrame, turns: int, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """The newest ``turns`` turns of each session, whole turns. The newest turn is one aggregated row
    for each session, joined back, so a session with very many messages is not sorted in one task."""
    newest = messages.groupBy(session).agg(F.max(turn).alias("__newest"))
    return messages.join(newest, session).where(F.col(turn) > F.col("__newest") - turns).drop("__newest")


def snapshot(messages: DataFrame, limit: int, session: str = "session_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The newest ``limit`` messages of each session; in a turn the assistant comes after the user.
    ``position`` counts them oldest first."""
    late = F.when(F.col(role) == "assistant", 1).otherwise(0)
    newest = Window.partitionBy(session).orderBy(F.desc(turn), late.desc(), F.desc(role))
    kept = messages.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= limit)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("__back")))).drop("__back")


def within_budget(messages: DataFrame, limit: int = 4, characters: int = 2400, session: str = "session_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """The context of a session: its last ``limit`` messages, newest first against a budget of
    characters; the message that crosses it is cut, older ones are left out."""
    s = snapshot(messages, limit, session, turn, role)
    newer = Window.partitionBy(session).orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__used", F.coalesce(F.sum(F.length(content)).over(newer), F.lit(0))).where(F.col("__used") < characters)
    room = F.least(F.length(content), characters - F.col("__used")).cast("int")
    cut = F.substring(F.col(content), F.lit(1), room)
    return s.withColumn("was_cut", F.length(content) > room).withColumn(content, cut).drop("__used")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` for each key; combines on the map side."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__r")).select(*keys, "__r.*")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the lowest ``order`` for each key: keep first, drop later repeats."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("__r")).select(key, "__r.*")


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def checkpoint_page(checkpoints: DataFrame, thread: str, before: str | None = None, metadata: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Checkpoints of a thread, newest first, below a cursor and with equal metadata entries."""
    c = checkpoints.where(F.col("thread_id") == thread)
    c = c if before is None else c.where(F.col("checkpoint_id") < before)
    for k, v in (metadata or {}).items():
        c = c.where(F.col("metadata")[k] == v)
    c = c.orderBy(F.desc("checkpoint_id"))
    return c if limit is None else c.limit(limit)


def with_blobs(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Channel values of checkpoints: versions (thread_id, ns, channel, version) with their blobs; empty ones are left out."""
    return versions.join(blobs, ["thread_id", "ns", "channel", "version"], "left").where("value_type <> 'empty'")


def put_writes(old: DataFrame, new: DataFrame, keys: list[str], index: str = "write_index") -> DataFrame:
    """Pending writes: a negative index replaces what is there, another is ignored if it exists."""
    o = old.withColumn("__new", F.lit(0))
    n = new.withColumn("__new", F.lit(1))
    others = [c for c in old.columns if c not in keys]
    rank = F.when(F.col(index) < 0, F.col("__new")).otherwise(-F.col("__new"))
    return o.unionByName(n).groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("__r")).select(*keys, "__r.*")


def with_writes(checkpoints: DataFrame, writes: DataFrame) -> DataFrame:
    """Checkpoints with their pending writes in order: array of (task_id, write_index, channel, value)."""
    keys = ["thread_id", "ns", "checkpoint_id"]
    w = writes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("task_id", "write_index", "channel", "value"))).alias("pending"))
    none = F.array().cast(w.schema["pending"].dataType)
    return checkpoints.join(w, keys, "left").withColumn("pending", F.coalesce("pending", none))


def traced(steps: DataFrame, key: str, order: str) -> DataFrame:
    """Steps of each key with their sequence from 1."""
    return steps.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(order)))
