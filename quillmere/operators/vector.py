"""Exact cosine search of a stated query set.

``nearest`` multiplies blocks of queries with batches of vectors as matrices and keeps k of a query
in each task, so what is shuffled is k rows a query and task. ``cosine_scores`` gives every pair,
for sets of queries whose whole ranking is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut
from .blocks import in_blocks

#: Queries that a task multiplies with a batch of vectors at once.
AT_ONCE = 256


def indexed(rows: DataFrame, key: str, embedding: str, dimension: int) -> DataFrame:
    """key, v (doubles), norm: usable vectors with their norm computed once."""
    r = rows.select(key, V.doubles(F.col(embedding)).alias("v"))
    return r.where(V.invalid_reason(F.col("v"), dimension).isNull()).withColumn("norm", V.norm(F.col("v")))


def rejected(rows: DataFrame, key: str, embedding: str, dimension: int) -> DataFrame:
    r = rows.select(key, V.invalid_reason(V.doubles(F.col(embedding)), dimension).alias("reason"))
    return r.where("reason is not null")


def cosine_scores(index: DataFrame, queries: DataFrame, key: str, query_key: str = "query_id", max_queries: int = 20_000) -> DataFrame:
    """query, key, score for all pairs. The stated queries are broadcast in blocks of about ``max_queries``."""

    def scored(block: DataFrame) -> DataFrame:
        q = block.select(query_key, F.col("v").alias("qv"), F.col("norm").alias("qnorm"))
        pairs = index.join(F.broadcast(q), F.size("v") == F.size("qv"))
        return pairs.select(query_key, key, (V.dot(F.col("v"), F.col("qv")) / (F.col("norm") * F.col("qnorm"))).alias("score"))

    return in_blocks(queries, query_key, max_queries, scored)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _best(score: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k highest scores and their keys, ties to the smaller key."""
    if score.shape[1] > k:
        # All that reach the k-th score stay in, so that ties are decided by key.
        floor = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
        most = int((score >= floor[:, None]).sum(axis=1).max())
        at = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(score), 1))
        score, keys = np.take_along_axis(score, at, 1), np.take_along_axis(keys, at, 1)
    order = np.lexsort((keys, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)


def nearest(index: DataFrame, queries: DataFrame, k: int, key: str, query_key: str = "query_id", dot: bool = False, other: bool = False, digits: int = 9, query_block: int = 8192) -> DataFrame:
    """query, key, score, rank: the k best vectors of each query by cosine (or inner product), ties to the
    smaller key. ``other`` leaves out the vector with the query's own key. Keys are integers.

    Both sides have v and norm (see ``indexed``). The stated queries are gathered and broadcast in
    blocks of ``query_block``, of which a task multiplies a few hundred at a time; a block's answers are
    stored and its broadcast freed before the next.
    """
    spark, done = index.sparkSession, []
    spec = f"{query_key} bigint, {key} bigint, score double"
    src = index.select(F.col(key).cast("bigint"), "v", "norm")

    def scored(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, norm = shared.value
            best = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    m, n = _matrix(part.column(1), q.shape[1]), part.column(2).to_numpy()
                    own = part.column(0).to_numpy()
                    for lo in range(0, len(ids), AT_ONCE):
                        some = slice(lo, lo + AT_ONCE)
                        s = q[some] @ m.T
                        s = np.round(s if dot else s / (norm[some, None] * n[None, :]), digits)
                        if other:
                            s[ids[some, None] == own[None, :]] = -np.inf
                        best[0][some], best[1][some] = _best(np.concatenate([best[0][some], s], axis=1), np.concatenate([best[1][some], np.broadcast_to(own, s.shape)], axis=1), k)
            row, at = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[1][row, at]), pa.array(best[0][row, at])], [query_key, key, "score"])

        return run

    last = None
    while True:
        block = (queries if last is None else queries.where(F.col(query_key) > last)).orderBy(query_key).limit(query_block).select(query_key, "v", "norm").collect()
        if block:
            shared = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block]), np.array([r[2] for r in block])))
            done.append(cut(src.mapInArrow(scored(shared), spec)))
            shared.unpersist()
            last = block[-1][0]
        if len(block) < query_block:
            break
    found = reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], spec)
    return top_k(found, k, key, query_key, digits=digits)


def top_k(scored: DataFrame, k: int, key: str, query_key: str = "query_id", ordinal: str | None = None, digits: int = 9) -> DataFrame:
    """The k best of each query; ties keep insertion order, which is the key unless ``ordinal`` names it."""
    s = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), ordinal or key)
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
