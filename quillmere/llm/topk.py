"""Exact top-k inner products by a three-phase uniform threshold.

A vector's score is the sum of its partial scores over ``lists`` slices of the dimensions; each
shard of vectors holds one local score list for each slice and query.

1. Every shard gathers the best entries of one of its lists (the lists take turns over shards)
   and resolves their scores. The k-th best of a query over all shards is a score that k entries
   reach, so it is a cutoff that no answer lies below.
2. The cutoffs of a block of queries are broadcast. An entry that reaches the cutoff reaches a
   uniform share of it, cutoff / lists, in one list at least.
3. A shard goes through its lists. An entry stays while its partial sum and the largest rest that
   the norms of the other slices allow can reach the cutoff; once few entries stay, only theirs
   are looked up in the remaining lists. Of the entries that are left, those that reach the
   uniform share in some list are sufficient; their scores are exact, and k of a query are kept.

The queries are a stated set. They are taken in blocks of ``query_block`` vectors; a block is
gathered and broadcast with that bound, and its answers are written and its broadcasts freed
before the next, so neither memory nor the plan grows with the number of queries. Arithmetic is
in float64 while it is exact, else in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

_SCORES = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v, the array of floor(scale * component). Rows whose vector is null or holds a
    null or non-finite component, and rows without an id, take no part."""
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull())
    return ok.where(~bad).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))


def _matrices(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector, ids ascending."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], flat[off[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))


def _shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        yield from _matrices(t.column(0).to_numpy(), t.column(1).combine_chunks() if isinstance(t.column(1), pa.ChunkedArray) and t.column(1).num_chunks != 1 else t.column(1).chunk(0))

    for b in batches:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            if sum(x.num_rows for x in held) >= rows:
                yield from flush()
                held = []
    if sum(x.num_rows for x in held):
        yield from flush()


def _long(score: int) -> int:
    """A score as a 64-bit integer; beyond that range it is the nearest bound."""
    return max(-(2**63), min(2**63 - 1, score))


def _leaders(p: np.ndarray, k: int) -> np.ndarray:
    """Columns of k of the highest scores of each row."""
    if p.shape[1] <= k:
        return np.tile(np.arange(p.shape[1]), (len(p), 1))
    order = np.argsort(-p, axis=1, kind="stable") if p.dtype == object else np.argpartition(p, p.shape[1] - k, axis=1)[:, ::-1]
    return order[:, :k]


def _kept(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its k entries of highest score, smaller ids first among equals."""
    level = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
    o = np.lexsort((ids, -level, row))
    begin = np.searchsorted(row[o], row[o], "left")
    o = o[np.arange(len(o)) - begin < k]
    return row[o], ids[o], score[o]


def _queries(block: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    by: dict[int, list] = {}
    for vec_id, v in block:
        by.setdefault(len(v), []).append((vec_id, v))
    return {d: (np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], float).reshape(len(rows), d)) for d, rows in by.items()}


def _blocks(queries: dict, m: np.ndarray, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First place, ids and vectors of the queries of a shard's length, a few at a time."""
    qids, q = queries.get(m.shape[1], (np.empty(0, np.int64), np.empty((0, m.shape[1]))))
    for at in range(0, len(qids), rows):
        yield at, qids[at : at + rows], q[at : at + rows]


def _slices(dim: int, lists: int) -> list[np.ndarray]:
    return [s for s in np.array_split(np.arange(dim), lists) if len(s)]


def _exactly(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and vectors as floats while every sum of products is exact, else as Python integers."""
    if np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(m.shape[1], 1) ** 2 < 2**52:
        return q, m
    whole = lambda x: np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
    return whole(q), whole(m)


def _resolved(q: np.ndarray, m: np.ndarray, row: np.ndarray, col: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over the dimensions ``at`` of single pairs, a bounded number at a time."""
    step, out = max(1, (1 << 22) // max(len(at), 1)), []
    for k in range(0, len(row), step):
        out.append((q[np.ix_(row[k : k + step], at)] * m[np.ix_(col[k : k + step], at)]).sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0, q.dtype)


def _gather(shared, k: int, lists: int, rows: int):
    """Phase 1: per query the k best resolved scores among the leaders of one list of each shard.
    A task keeps k scores a query and sends them once."""

    def run(batches):
        queries = _queries(shared.value)
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for turn, (ids, m) in enumerate(_shards(batches, rows)):
            slices = _slices(m.shape[1], lists)
            for at, own, q in _blocks(queries, m):
                q, v = _exactly(q, m)
                if slices:
                    s = slices[turn % len(slices)]
                    seen = _leaders(q[:, s] @ v[:, s].T, k + 1)
                else:
                    seen = _leaders(np.zeros((len(q), len(v))), k + 1)
                who = np.repeat(np.arange(len(q)), seen.shape[1])
                score = _resolved(q, v, who, seen.ravel(), np.arange(m.shape[1])).reshape(seen.shape)
                score[ids[seen] == own[:, None]] = -np.inf
                key = (m.shape[1], at)
                held = best[key][1] if key in best else score[:, :0]
                best[key] = (own, np.sort(np.concatenate([held, score], axis=1), axis=1)[:, -k:])
        for own, score in best.values():
            row, at = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(own[row], pa.int64()), pa.array([_long(int(x)) for x in score[row, at]], pa.int64())], ["query_id", "score"])

    return run


def _sufficient(q: np.ndarray, m: np.ndarray, cut: np.ndarray, lists: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of ``q`` and ``m`` whose score reaches the cutoff, the scores, and how many slice products were made.

    The rest that slices can still add is bounded by the product of their norms. Norms are float, so
    the bound is widened; pairs in ``skip`` are left out.
    """
    slices = _slices(m.shape[1], lists)
    if not slices:
        row, col = np.nonzero(~skip & (cut <= 0).astype(bool))
        return row, col, np.zeros(len(row), q.dtype), 0
    norms = [(np.linalg.norm(q[:, s].astype(float), axis=1), np.linalg.norm(m[:, s].astype(float), axis=1)) for s in slices]
    row = col = None
    stays, total, share, made = ~skip, np.zeros((len(q), len(m)), q.dtype), None, 0
    for j, s in enumerate(slices):
        if row is None:
            p = q[:, s] @ m[:, s].T
            made += p.size
            total = total + p
            enough = (p * len(slices) >= cut).astype(bool)
            share = enough if share is None else share | enough
        else:
            p = _resolved(q, m, row, col, s)
            made += len(p)
            total = total + p
            share = share | (p * len(slices) >= cut[row, 0]).astype(bool)
        rest = sum((np.outer(a, b) if row is None else a[row] * b[col] for a, b in norms[j + 1 :]), 0.0)
        may = (total + rest * (1 + 1e-9) + 1 >= (cut if row is None else cut[row, 0])).astype(bool)
        if row is not None:
            row, col, total, share = row[may], col[may], total[may], share[may]
        else:
            stays &= may
            if j + 1 == len(slices) or np.count_nonzero(stays) * 4 < stays.size:
                row, col = np.nonzero(stays)
                total, share = total[row, col], share[row, col]
    on = share & (total >= cut[row, 0]).astype(bool)
    return row[on], col[on], total[on], made


def _collect(shared, cutoffs, k: int, lists: int, rows: int, tally=None):
    """Phase 3: entries above the uniform threshold in some list, resolved; a task sends k a query at most."""

    def run(batches):
        queries = _queries(shared.value)
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for ids, m in _shards(batches, rows):
            for at, own, q in _blocks(queries, m):
                q, v = _exactly(q, m)
                cut = np.array([cutoffs.value.get(int(i), -np.inf) for i in own], q.dtype)[:, None]
                row, j, score, made = _sufficient(q, v, cut, lists, ids == own[:, None])
                if tally is not None:
                    tally.add(made)
                key = (m.shape[1], at)
                new = (row, ids[j], score)
                held = best[key][1:] if key in best else tuple(x[:0] for x in new)
                best[key] = (own, *_kept(*(np.concatenate(x) for x in zip(held, new, strict=True)), k))
        for own, row, found, score in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(own[row], pa.int64()), pa.array(found, pa.int64()), pa.array([_long(int(x)) for x in score], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 4, query_block: int = 1 << 15, shard_rows: int = 4096, tally=None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best among ``vectors`` by (score desc,
    vec_id). Both inputs have vec_id and v (see ``quantised``); a vector is no candidate for
    itself (equal vec_id), and vectors of another length are no candidates. A repeated query id
    is one query (its smallest vector); repeated candidates each count. A score beyond 64 bits is
    given as the bound. An empty table gives no row. Only vec_id and v are read. ``tally``, an
    accumulator, counts the products of a query's slice and a vector's that phase 3 makes."""
    spark = vectors.sparkSession
    space = Workspace(spark, "topk")
    stated = space.write(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, last = 0, None
    while True:
        block = (stated if last is None else stated.where(F.col("vec_id") > last)).orderBy("vec_id").limit(query_block).collect()
        if not block:
            break
        last, full = block[-1][0], len(block) == query_block
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in block])
        del block
        gathered = vectors.mapInArrow(_gather(shared, k, lists, shard_rows), "query_id bigint, score bigint")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        # At most query_block rows: one cutoff for each query of the block.
        kth = gathered.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", "score").collect()
        # A cutoff at the lower bound of 64 bits may stand for a lower one, so it cuts nothing.
        cutoffs = spark.sparkContext.broadcast({r[0]: r[1] for r in kth if r[1] > -(2**63)})
        found = _ranked(vectors.mapInArrow(_collect(shared, cutoffs, k, lists, shard_rows, tally), _SCORES), k)
        space.write(found.select("query_id", "rank", "vec_id", "score"), f"answers/block={n}")
        shared.unpersist()
        cutoffs.unpersist()
        n += 1
        if not full:
            break
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", block int").parquet(space.path("answers")).drop("block")


def op7_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best neighbours of every vector whose id is divisible by 50, among all vectors."""
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
