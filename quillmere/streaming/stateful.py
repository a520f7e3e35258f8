"""Keyed state that ends: sessions of the workflow with a timer, and conversation memory as a ring.

Both keep their state in the state store of the query (RocksDB, see ``state_store``), and both give it
back: a workflow session that nobody goes on with is closed by an event-time timer, and a memory keeps
its newest turns only and has a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import workflow as W
from ..operators.safety import redact


def state_store(spark: SparkSession) -> None:
    """Processors with several states need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Workflow(StatefulProcessor):
    """The same transitions as in a batch; a session's state is its draft's status and revision."""

    def __init__(self, idle_ms: int):
        self.idle_ms, (self.moves, self.rules) = idle_ms, W.tables()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("session", "status int, revision long, turn long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, revision, turn = self.held.get() if self.held.exists() else (0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values(["at", "code"], kind="stable")
        out = []
        for code in pdf["code"]:
            before, rule = status, self.rules[code, status]
            status = int(self.moves[code, status])
            revision = 1 if rule == W.FIRST else revision + int(rule == W.NEXT)
            turn += 1
            out.append((key[0], turn, int(code), before, status, revision))
        self.held.update((status, revision, turn))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(int(pdf["at"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "turn", "code", "before", "after", "count"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, revision, turn = self.held.get()
        self.held.clear()
        yield pd.DataFrame([(key[0], turn, -1, status, 0, revision)], columns=["session_id", "turn", "code", "before", "after", "count"])

    def close(self) -> None:
        pass


def workflow_sessions(turns: DataFrame, text: str = "text", ready: Column | None = None, session: str = "session_id", at: str = "at", delay: str = "10 minutes", idle_minutes: int = 30) -> DataFrame:
    """The workflow over a stream of turns: one row a turn as ``workflow.workflow`` gives it (turns are numbered
    in the order of ``at``), and a row with the outcome ``abandoned`` for a session without a turn for
    ``idle_minutes``, whose state is dropped. Turns behind the watermark are left out."""
    state_store(turns.sparkSession)
    code = W.codes(F.col(text), F.lit(False) if ready is None else ready)
    coded = turns.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).select(F.col(session).cast("string").alias("session_id"), F.col(at).alias("at"), code.alias("code"))
    folded = coded.groupBy("session_id").transformWithStateInPandas(_Workflow(idle_minutes * 60_000), "session_id string, turn long, code int, before int, after int, count long", "Append", "EventTime")
    gone = F.col("code") < 0
    named = W.described(folded.withColumn("gone", gone).withColumn("code", F.greatest("code", F.lit(0))))
    none = F.array().cast("array<string>")
    return named.withColumn("outcome", F.when(F.col("gone"), "abandoned").otherwise(F.col("outcome"))).withColumn("nodes", F.when(F.col("gone"), none).otherwise(F.col("nodes"))).drop("gone")


class _Memory(StatefulProcessor):
    """The newest messages of a session as a list, and the number of turns so far."""

    def __init__(self, keep_turns: int, ttl_ms: int | None, context: int):
        self.keep_turns, self.ttl_ms, self.context = keep_turns, ttl_ms, context

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = "turn long, role string, content string"
        self.last, self.ring = handle.getValueState("last", "turn long", ttlDurationMs=self.ttl_ms), handle.getListState("ring", fields, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn = self.last.get()[0] if self.last.exists() else 0
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["place"], kind="stable")
        turns = []
        for role, content in zip(pdf["role"], pdf["content"], strict=True):
            turn += role == "user"
            turns.append(max(turn, 1))
            ring.append((max(turn, 1), role, content))
        first = lambda t: max(1, t - self.keep_turns + 1)
        ring = [r for r in ring if r[0] >= first(max(turn, 1))]
        self.last.update((turn,))
        self.ring.put(ring)
        context = [f"{role}: {content}" for _, role, content in ring[-self.context :]]
        yield pd.DataFrame({"session_id": [key[0]] * len(pdf), "turn": turns, "role": pdf["role"], "content": pdf["content"], "oldest_kept": [first(t) for t in turns], "n_held": [len(ring)] * len(pdf), "context": [context] * len(pdf)})

    def close(self) -> None:
        pass


def memory(messages: DataFrame, keep_turns: int = 50, session: str = "session_id", order: str | None = None, limit: int = 2000, ttl_minutes: int | None = 1440, context: int = 4) -> DataFrame:
    """session_id, turn, role, content of every message, with oldest_kept (the first turn that memory still
    has), n_held (messages in it) and the session's newest messages as context.

    A user's message begins a turn. Messages of a micro-batch are taken in order of ``order``; secrets are
    redacted before anything is kept, and blank messages go. State holds the newest ``keep_turns`` turns of
    a session, and ends ``ttl_minutes`` after its last message (None: never); turns begin anew then."""
    state_store(messages.sparkSession)
    m = messages.withColumn("content", redact(F.col("content"), limit)["content"]).where("content is not null")
    place = F.col(order).cast("double") if order else F.lit(0.0)
    rows = m.select(F.col(session).cast("string").alias("session_id"), "role", "content", place.alias("place"))
    ttl = None if ttl_minutes is None else ttl_minutes * 60_000
    fields = "session_id string, turn long, role string, content string, oldest_kept long, n_held long, context array<string>"
    return rows.groupBy("session_id").transformWithStateInPandas(_Memory(keep_turns, ttl, context), fields, "Append", "None" if ttl is None else "ProcessingTime")
