"""The conversation workflow as a state machine: turns, drafts, and a confirmation that interrupts it.

What a turn says is a column (``codes``); what it does hangs on the state of the session's draft alone,
so a transition is a lookup in a small table, the same for a batch and a stream. Once a draft is ready
the workflow stops at a gate, and the next turn resumes it there: an explicit command goes on, anything
else is answered with the question that is open.

``fold_states`` runs such a table over ordered events of any key. Events are dealt out by ranges of key
and order, so that a session which holds a third of all turns lies in many tasks. A task first tells what
its piece makes of every state that the piece could begin in; the pieces are chained, which takes one row
a task, and then every task knows the state it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from . import requests as R
from .safety import command

#: States of a draft, intents, commands and nodes (states from 0, which is none).
STATUSES = (None, "waiting_for_information", "waiting_for_confirmation", "confirmed", "submitted", "cancelled")
INTENTS = ("policy_query", "material_check", "approval_query", "draft_generation", "unknown")
COMMANDS = (None, "submit_draft", "confirm_draft", "cancel_draft", "update_draft")
NODES = ("resolve_turn", "classify_intent", "answer_policy", "check_materials", "check_approval", "generate_draft", "update_draft", "await_confirmation", "human_confirmation_gate", "confirm_draft", "submit_approval", "cancel_draft", "request_clarification")
_SERVES = dict(zip(INTENTS, ("answer_policy", "check_materials", "check_approval", "generate_draft", "request_clarification"), strict=True))
_GATE = ("await_confirmation", "human_confirmation_gate")
#: What becomes of a draft's revision: it stays, rises by one, or begins at one.
KEEP, NEXT, FIRST = 0, 1, 2
N_CODES = len(INTENTS) * len(COMMANDS) * 4


def step(status: str | None, intent: str, said: str | None, standalone: bool, ready: bool) -> tuple[str | None, int, str, tuple[str, ...]]:
    """The draft's status after a turn, its revision, the outcome, and the nodes that the turn runs through.
    ``said`` is the explicit command, ``standalone`` whether the turn asks for something of its own, ``ready``
    whether the draft that it makes or changes lacks nothing."""
    pending, path = status == "waiting_for_confirmation", ("resolve_turn",)
    if pending and said is None:
        return status, KEEP, "confirmation_pending", ()
    if pending:
        path = ("resolve_turn", "human_confirmation_gate")
    if said == "submit_draft" or (status is not None and said is not None):
        action = said
    elif status == "waiting_for_information" and not standalone:
        action = "update_draft"
    else:
        action = "new_request"
    made = "waiting_for_confirmation" if ready else "waiting_for_information"
    if action == "new_request":
        path += ("classify_intent", _SERVES[intent])
        if intent != "draft_generation":
            return status, KEEP, "clarification" if intent == "unknown" else "answered", path
        return made, FIRST, "draft_ready" if ready else "draft_incomplete", path + (_GATE if ready else ())
    if action == "update_draft":
        if status == "submitted":
            return status, KEEP, "rejected_after_submission", (*path, "update_draft")
        return made, NEXT, "draft_ready" if ready else "draft_incomplete", (*path, "update_draft", *(_GATE if ready else ()))
    if action == "confirm_draft":
        outcome = {"waiting_for_confirmation": "confirmed", "confirmed": "confirmed", "submitted": "already_submitted", "cancelled": "draft_cancelled"}.get(status, "draft_incomplete")
        return "confirmed" if outcome == "confirmed" else status, KEEP, outcome, (*path, "confirm_draft")
    if action == "cancel_draft":
        return ("submitted", KEEP, "already_submitted", (*path, "cancel_draft")) if status == "submitted" else ("cancelled", KEEP, "cancelled", (*path, "cancel_draft"))
    outcome = {None: "draft_missing", "cancelled": "draft_cancelled", "confirmed": "submitted", "submitted": "replayed"}.get(status, "confirmation_required")
    return "submitted" if outcome == "submitted" else status, KEEP, outcome, (*path, "submit_approval", *(_GATE if pending else ()))


def _every() -> list[tuple]:
    """``step`` of every code and status, by code then status."""
    out = []
    for code in range(N_CODES):
        rest, ready = divmod(code, 2)
        rest, standalone = divmod(rest, 2)
        intent, said = divmod(rest, len(COMMANDS))
        out += [step(s, INTENTS[intent], COMMANDS[said], bool(standalone), bool(ready)) for s in STATUSES]
    return out


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next status and revision rule, by code and status."""
    every = _every()
    shape = (N_CODES, len(STATUSES))
    return np.array([STATUSES.index(x[0]) for x in every]).reshape(shape), np.array([x[1] for x in every]).reshape(shape)


def codes(text: Column, ready: Column) -> Column:
    """What a turn says, as one number."""
    k, intent = command(text), R.intent(text)
    said = F.when(k.isin(*R.SUBMIT), 1).when(k.isin(*R.CONFIRM), 2).when(k.isin(*R.CANCEL), 3).when(T.has_any(k, R.UPDATE), 4).otherwise(0)
    place = F.coalesce(F.array_position(F.array(*[F.lit(i) for i in INTENTS]), intent) - 1, F.lit(len(INTENTS) - 1))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return (((place * len(COMMANDS) + said) * 2 + flag(T.has_any(text, R.STANDALONE))) * 2 + flag(ready)).cast("int")


# --- folds of a table over ordered events --------------------------------------------------------


def _cut_points(keys: pa.Array) -> np.ndarray:
    """Where a key begins in a batch, without the first."""
    if len(keys) < 2:
        return np.zeros(0, np.int64)
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False) if not keys.null_count else np.array([hash((v is None, v)) for v in keys.to_pylist()])
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def _text(v) -> str:
    return "n" if v is None else f"v{v}"


def _pieces(moves: np.ndarray, rules: np.ndarray):
    """A task's events -> its first and last key, whether they are one run, and what the last key's run
    makes of each state: the state, what it adds to the count, and whether it sets it anew."""
    n = moves.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        single, state, add, anew = True, list(range(n)), [0] * n, [False] * n
        for b in batches:
            if not b.num_rows:
                continue
            keys, cuts = b.column(0), _cut_points(b.column(0))
            begins, ends = _text(keys[0].as_py()), _text(keys[b.num_rows - 1].as_py())
            fresh = last is not None and begins != last
            first = begins if first is None else first
            single &= not fresh and not len(cuts)
            if fresh or len(cuts):
                state, add, anew = list(range(n)), [0] * n, [False] * n
            last = ends
            for code in b.column(2).slice(int(cuts[-1]) if len(cuts) else 0).to_pylist():
                for s in range(n):
                    rule, state[s] = rules[code, state[s]], moves[code, state[s]]
                    if rule == FIRST:
                        add[s], anew[s] = 1, True
                    else:
                        add[s] += rule == NEXT
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"piece": TaskContext.get().partitionId(), "first": first, "last": last, "single": single, "state": [int(x) for x in state], "add": [int(x) for x in add], "anew": anew}], schema=_PIECE)

    return run


_PIECE = pa.schema([("piece", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("state", pa.list_(pa.int64())), ("add", pa.list_(pa.int64())), ("anew", pa.list_(pa.bool_()))])
_PIECES = "piece bigint, first string, last string, single boolean, state array<bigint>, add array<bigint>, anew array<boolean>"


def fold_states(events: DataFrame, key: str, order: str, code: str, moves: np.ndarray, rules: np.ndarray, parts: int | None = None) -> DataFrame:
    """key, order, code of every event with before and after (states, from 0 for a key's first event) and
    count (a number that begins at 0 and follows ``rules``). Events of one place go by their code. ``parts`` is the number of ranges, if not Spark's choice."""
    names = (key, order, code)
    dealt = events.select(*names).repartitionByRange(*([parts] if parts else []), *names)
    stored = cut(dealt.sortWithinPartitions(*names))
    pieces = sorted(stored.mapInArrow(_pieces(moves, rules), _PIECES).collect(), key=lambda r: r["piece"])  # one row a task
    begin, held = {}, (None, 0, 0)
    for p in pieces:
        begin[p["piece"]] = held
        state, count = (held[1], held[2]) if p["single"] and held[0] == p["first"] else (0, 0)
        held = p["last"], p["state"][state], p["add"][state] + (0 if p["anew"][state] else count)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, count = begin.get(TaskContext.get().partitionId(), (None, 0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            keys, cuts = b.column(0), set(_cut_points(b.column(0)).tolist())
            if _text(keys[0].as_py()) != last:
                cuts.add(0)
            before, after, counts = [], [], []
            for i, c in enumerate(b.column(2).to_pylist()):
                if i in cuts:
                    state, count = 0, 0
                before.append(state)
                rule, state = rules[c, state], int(moves[c, state])
                count = 1 if rule == FIRST else count + int(rule == NEXT)
                after.append(state)
                counts.append(count)
            last = _text(keys[b.num_rows - 1].as_py())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(counts, pa.int64())], [*names, "before", "after", "count"])

    return stored.mapInArrow(run, f"{fields}, before int, after int, count bigint")


def _named(places: Column, names: tuple) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), places)


def described(folded: DataFrame, code: str = "code") -> DataFrame:
    """``folded`` with draft_status, pending, revision, outcome and nodes in place of numbers."""
    every = _every()
    at = F.col(code) * len(STATUSES) + F.col("before")
    paths = sorted({x[3] for x in every})
    path = F.get(F.array(*[F.array(*[F.lit(n) for n in p]).cast("array<string>") for p in paths]), F.get(F.array(*[F.lit(paths.index(x[3])) for x in every]), at))
    return folded.select(
        *[c for c in folded.columns if c not in (code, "before", "after", "count")],
        _named(F.col("after"), STATUSES).alias("draft_status"),
        (F.col("after") == STATUSES.index("waiting_for_confirmation")).alias("pending"),
        F.col("count").alias("revision"),
        F.get(F.array(*[F.lit(x[2]) for x in every]), at).alias("outcome"),
        path.alias("nodes"),
    )


def workflow(turns: DataFrame, text: str = "text", ready: Column | None = None, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """session, turn, draft_status, pending (stopped at the confirmation), revision, outcome, nodes after each
    turn. ``ready`` tells whether the draft that a turn makes or changes lacks nothing; none does without it."""
    done = F.lit(False) if ready is None else ready
    coded = turns.select(session, turn, codes(F.col(text), done).alias("code"))
    return described(fold_states(coded, session, turn, "code", *tables()))
