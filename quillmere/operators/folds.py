"""Sequential folds: one key's events in order, where a window cannot express the state.

A fold that starts afresh after a pause is cut into islands by a window first, so that a busy key
is many groups; a plain function then runs over the ordered events of one island, with the
key's columns only. It jumps from one change of state to the next by binary search where it can.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import requests as R
from . import workflow as W


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def islands(events: DataFrame, key: str, order: str, until: Column) -> DataFrame:
    """``events`` (us: time) with island: a new one starts where all earlier ``until`` of the key have passed."""
    w = Window.partitionBy(key).orderBy("us", order).rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("__until", until)
    fresh = F.coalesce((F.col("us") >= F.max("__until").over(w)).cast("int"), F.lit(1))
    running = Window.partitionBy(key).orderBy("us", order).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(running)).drop("__until", "__fresh")


def _in_order(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole islands in a task, one after the other, each in order."""
    return events.repartition(*keys).sortWithinPartitions(*keys, "us", order)


def _by_island(events: DataFrame, keys: list[str], order: str, fold: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``fold`` over whole islands, many at a time: the events in order, and where each island starts.
    A task holds one Arrow batch and one island."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and (held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any():
                yield whole(pd.concat(held))
                held = []
            starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            if len(starts) > 1:
                yield whole(pd.concat([*held, pdf.iloc[: starts[-1]]]))
                held, pdf = [], pdf.iloc[starts[-1] :]
            held.append(pdf)
        if held:
            yield whole(pd.concat(held))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        return fold(pdf, np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()))

    return _in_order(events, keys, order).mapInPandas(run, schema)


def _jumps(us: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which events open a span: the first of an island, and each first one at or after the end of the last span."""
    # Islands are laid one behind the other in time, so that one search serves all.
    island = np.searchsorted(starts, np.arange(len(us)), side="right") - 1
    span = int(end.max() - us.min()) + 1 if len(us) else 1
    shift = island * span - us[starts][island] + (us.min() if len(us) else 0)
    us, end = us + shift, np.minimum(end + shift, (island + 1) * span + (us.min() if len(us) else 0))
    opens, at = np.zeros(len(us), bool), 0
    while at < len(us):
        opens[at] = True
        at = max(at + 1, int(np.searchsorted(us, end[at], "left")))
    return opens


def ttl_cache(calls: DataFrame, ttl_seconds: float, key: str = "key", at: str = "ts", order: str = "event_id", bypass: Column | None = None, read_error: Column | None = None, write_error: Column | None = None) -> DataFrame:
    """outcome of each call: hit, miss, bypass or error. An entry lives ``ttl_seconds`` from its write;
    hits don't extend it.

    A call with ``bypass`` never asks the cache. A call whose read fails is an error: it neither finds
    nor writes. A miss whose write fails stays a miss and leaves no entry, so the next call misses too.
    """
    if ttl_seconds <= 0:
        raise ValueError("an entry lives some time")
    ttl, no = int(ttl_seconds * 1e6), F.lit(False)
    src = calls.select(key, order, _micros(F.col(at)).alias("us"), *[F.coalesce(no if c is None else c, no).alias(n) for n, c in (("bypass", bypass), ("read_error", read_error), ("write_error", write_error))])
    aside = F.when(F.col("bypass"), "bypass").when(F.col("read_error"), "error")
    asked = islands(src.where(aside.isNull()), key, order, F.col("us") + ttl)

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        us, lost = pdf["us"].to_numpy(), pdf["write_error"].to_numpy()
        miss = _jumps(us, np.where(lost, us, us + ttl), starts)
        return pdf.assign(outcome=np.where(miss, "miss", "hit"))[[key, order, "outcome"]]

    done = _by_island(asked, [key, "island"], order, fold, f"{key} {_type(calls, key)}, {order} {_type(calls, order)}, outcome string")
    return done.unionByName(src.where(aside.isNotNull()).select(key, order, aside.alias("outcome")))


def cache_summary(outcomes: DataFrame) -> DataFrame:
    """hits, misses, bypasses and errors."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("hit", "hits"), ("miss", "misses"), ("bypass", "bypasses"), ("error", "errors"))])


def single_flight(calls: DataFrame, key: str = "key", start: str = "start", seconds: str = "seconds", order: str = "event_id", process: str | None = None, max_keys: int | None = None) -> DataFrame:
    """role of each call: the first of a key leads for its duration; calls that start within it follow.

    With ``process`` and ``max_keys``, a process holds at most that many keys in flight: a call of
    another key is an overflow, runs alone and is joined by nobody.
    """
    columns = [key, order] + ([process] if process else [])
    src = calls.select(*columns, _micros(F.col(start)).alias("us"), (F.col(seconds) * 1_000_000).cast("bigint").alias("took"))
    schema = f"{key} {_type(calls, key)}, {order} {_type(calls, order)}, role string"
    if max_keys is None:

        def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            us = pdf["us"].to_numpy()
            return pdf.assign(role=np.where(_jumps(us, us + pdf["took"].to_numpy(), starts), "leader", "follower"))[[key, order, "role"]]

        return _by_island(islands(src, key, order, F.col("us") + F.col("took")), [key, "island"], order, fold, schema)

    def registry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # What is open goes on from batch to batch: at most max_keys keys, however long an island is.
        ends: dict[object, int] = {}
        due: list[tuple[int, object]] = []
        at: tuple | None = None
        for pdf in batches:
            roles = []
            for p, island, us, took, k in zip(*(pdf[c].tolist() for c in (process, "island", "us", "took", key)), strict=True):
                if (p, island) != at:
                    ends, due, at = {}, [], (p, island)
                while due and due[0][0] <= us:
                    end, old = heapq.heappop(due)
                    if ends.get(old) == end:
                        del ends[old]
                if k in ends:
                    roles.append("follower")
                elif len(ends) >= max_keys:
                    roles.append("overflow")
                else:
                    ends[k] = us + took
                    heapq.heappush(due, (us + took, k))
                    roles.append("leader")
            yield pdf.assign(role=roles)[[key, order, "role"]]

    return _in_order(islands(src, process, order, F.col("us") + F.col("took")), [process, "island"], order).mapInPandas(registry, schema)


def fifo_limiter(calls: DataFrame, max_concurrency: int, max_queue: int, timeout_seconds: float, key: str = "provider", start: str = "start", seconds: str = "seconds", order: str = "event_id") -> DataFrame:
    """outcome and wait of calls to a provider with a bounded number of slots and a first-in queue:
    started, queued (started after a wait), rejected (queue full) or timed_out."""
    if max_concurrency < 1 or max_queue < 0 or timeout_seconds <= 0:
        raise ValueError("a limiter has slots, a queue of some length and a timeout")
    src = calls.select(key, order, _micros(F.col(start)).alias("us"), F.col(seconds).alias("s"))
    # A call that starts at all starts within the timeout, so an idle provider starts afresh.
    src = islands(src, key, order, F.col("us") + F.lit(int(timeout_seconds * 1e6)) + (F.col("s") * 1_000_000).cast("bigint"))

    limit = int(timeout_seconds * 1e6)

    def simulate(arrivals: list[int], lengths: list[float]) -> tuple[list[str], list[float]]:
        busy: list[int] = []  # ends of running calls
        queue: list[tuple[int, int, int]] = []  # index, arrival, duration
        outcome, wait = ["started"] * len(arrivals), [0.0] * len(arrivals)

        def advance(now: int) -> None:
            while queue:
                i, came, took = queue[0]
                free = busy[0] if len(busy) >= max_concurrency else came
                begins = max(free, came)
                if begins > came + limit:
                    if came + limit > now:
                        return
                    outcome[i] = "timed_out"
                    wait[i] = timeout_seconds * 1e3
                    queue.pop(0)
                    continue
                if begins > now:
                    return
                if len(busy) >= max_concurrency:
                    heapq.heappop(busy)
                heapq.heappush(busy, begins + took)
                wait[i] = (begins - came) / 1e3
                queue.pop(0)

        for i, (us, s) in enumerate(zip(arrivals, lengths, strict=True)):
            took = int(s * 1e6)
            advance(us)
            while busy and busy[0] <= us:
                heapq.heappop(busy)
            if len(busy) < max_concurrency and not queue:
                heapq.heappush(busy, us + took)
            elif len(queue) >= max_queue:
                outcome[i] = "rejected"
            else:
                outcome[i] = "queued"
                queue.append((i, us, took))
        advance(1 << 62)
        return outcome, wait

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        us, took, outcome, wait = pdf["us"].tolist(), pdf["s"].tolist(), [], []
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            o, w = simulate(us[a:b], took[a:b])
            outcome += o
            wait += w
        return pdf.assign(outcome=outcome, wait_ms=wait)[[key, order, "outcome", "wait_ms"]]

    return _by_island(src, [key, "island"], order, fold, f"{key} {_type(calls, key)}, {order} {_type(calls, order)}, outcome string, wait_ms double")


def limiter_summary(outcomes: DataFrame, key: str = "provider") -> DataFrame:
    """Counts of a limiter's outcomes by provider, and the average wait of the calls that started."""
    started = F.col("outcome").isin("started", "queued")
    counts = [F.count_if(F.col("outcome") == o).alias(n) for o, n in (("rejected", "rejected"), ("timed_out", "timed_out"))]
    g = outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("outcome") != "rejected").alias("accepted"), F.count_if(started).alias("started"), *counts, F.round(F.avg(F.when(started, F.col("wait_ms"))), 3).alias("average_wait_ms"))
    return g.withColumn("average_wait_ms", F.coalesce("average_wait_ms", F.lit(0.0)))


#: The states and actions of ``session_workflow``.
_DRAFT = (None, "waiting_for_information", "confirmed", "submitted", "cancelled")
_ACTIONS = ("new_request", "update_draft", "confirm_draft", "cancel_draft", "submit_draft")


def _drafted(status: str | None, action: str, asked: bool) -> tuple[str | None, int]:
    """A draft's status after an action, and what becomes of its revision."""
    if action == "new_request" and asked:
        return "waiting_for_information", W.FIRST
    if action == "update_draft" and status in ("waiting_for_information", "confirmed"):
        return "waiting_for_information", W.NEXT
    if action == "confirm_draft" and status == "waiting_for_information":
        return "confirmed", W.KEEP
    if action == "cancel_draft" and status not in (None, "submitted"):
        return "cancelled", W.KEEP
    return ("submitted" if action == "submit_draft" and status == "confirmed" else status), W.KEEP


def session_workflow(messages: DataFrame, text: str = "text", session: str = "session_id", turn: str = "turn") -> DataFrame:
    """session, turn, intent, action, draft_status, revision: the state of a session's draft after each turn.

    Intent and commands are columns; what a turn does in each state is one number, and the states are folded
    by ``workflow.fold_states``, so that a session of any length is cut over tasks.
    """
    c, n = F.col(text), len(_ACTIONS)
    place = lambda a: (F.array_position(F.array(*[F.lit(x) for x in _ACTIONS]), a) - 1).cast("int")
    by_status = [R.turn_action(c, F.lit(s).cast("string")) for s in (None, "waiting_for_information", "confirmed")]
    bare, waiting, held = (place(a) for a in by_status)
    pre = messages.select(session, turn, ((((bare * n + waiting) * n + held) * 2) + (R.intent(c) == "draft_generation").cast("int")).cast("int").alias("code"), R.intent(c).alias("intent"))
    moves, rules = np.zeros((2 * n**3, len(_DRAFT)), int), np.zeros((2 * n**3, len(_DRAFT)), int)
    for code in range(2 * n**3):
        which = (code // 2 // n // n, code // 2 // n % n, code // 2 % n)
        for i, status in enumerate(_DRAFT):
            after, rules[code, i] = _drafted(status, _ACTIONS[which[min(i, 2)]], code % 2 == 1)
            moves[code, i] = _DRAFT.index(after)
    intents = ("policy_query", "material_check", "approval_query", "draft_generation", "unknown")
    which = F.when(F.col("before") == 0, F.floor(F.col("code") / (2 * n * n))).when(F.col("before") == 1, F.floor(F.col("code") / (2 * n)) % n).otherwise(F.floor(F.col("code") / 2) % n)
    # The intent travels in the code, beyond what the tables read.
    at = F.coalesce(F.array_position(F.array(*[F.lit(i) for i in intents]), F.col("intent")) - 1, F.lit(len(intents) - 1))
    wide = pre.select(session, turn, (F.col("code") + 2 * n**3 * at).cast("int").alias("code"))
    folded = W.fold_states(wide, session, turn, "code", np.tile(moves, (len(intents), 1)), np.tile(rules, (len(intents), 1)))
    intent = F.get(F.array(*[F.lit(i) for i in intents]), F.floor(F.col("code") / (2 * n**3)).cast("int"))
    folded = folded.withColumn("intent", intent).withColumn("code", F.col("code") % (2 * n**3))
    return folded.select(session, turn, "intent", F.get(F.array(*[F.lit(a) for a in _ACTIONS]), which.cast("int")).alias("action"), F.get(F.array(*[F.lit(s) for s in _DRAFT]), F.col("after")).alias("draft_status"), F.col("count").alias("revision"))


def revise(revisions: DataFrame, draft: str = "draft_id", order: str = "revision") -> DataFrame:
    """draft, revision, fields: each revision's fields laid over all earlier ones (a running map merge).

    Later values win key by key; a window over (draft, field) carries the last value forward.
    """
    long = revisions.select(draft, order, F.explode("fields").alias("k", "v"))
    grid = revisions.select(draft, order).join(long.select(draft, "k").distinct(), draft)
    w = Window.partitionBy(draft, "k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(long, [draft, order, "k"], "left").withColumn("v", F.last("v", ignorenulls=True).over(w)).where("v is not null")
    return filled.groupBy(draft, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("fields"))
