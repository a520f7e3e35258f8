"""A stored inverted index with score bounds, for exact BM25 of any number of queries.

Documents are indexed as they lie, in shards of a few thousand, each one row of a table: a
dictionary of its terms, a posting list for each, and the lists cut into blocks by ranges of
documents. A block carries its largest term count and its shortest document, which bound every score
in it whatever the corpus statistics are, so a shard stays right when others join the table.

A query adds up the bounds of its terms' blocks for every range of documents, takes the ranges in
order of their bounds, and stops at the first that can't reach its k-th score. Blocks of the other
ranges are never scored. A task carries each query's k best from shard to shard, and sends those.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import LARGE_ROWS, cut, rows_at_once, stored

_COLUMNS = ("ids", "lengths", "terms", "lists", "local", "tf", "blocks", "ranges", "begins", "most_tf", "least_dl")
_SHARDS = "shard bigint, n bigint, dl bigint, " + ", ".join(f"{c} binary" for c in _COLUMNS)
#: Without least and greatest values of the columns: a writer keeps them, whole, of every row group until the file ends.
_WRITTEN = LARGE_ROWS | {"parquet.column.statistics.enabled": "false"}
#: Documents of a range.
RANGE = 64
#: What bounds and scores may differ by through rounding; the order of summation adds a part that grows with the terms.
SLACK = 1e-9
#: Postings that are scored at once, unless a single range has more.
POSTINGS = 1 << 20
#: Terms of a block of queries, unless a single query has more.
BLOCK_TERMS = 1 << 16


def _ipc(values: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("v", values.type)])) as w:
        w.write(pa.record_batch([values], ["v"]))
    return sink.getvalue().to_pybytes()


def _inverted(ids: np.ndarray, lengths: np.ndarray, terms: pa.ListArray) -> dict[str, bytes]:
    """The columns of one shard."""
    words = pc.dictionary_encode(terms.flatten())
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
    known = words.indices.is_valid().to_numpy(zero_copy_only=False)
    pair, tf = np.unique(code[known] * len(ids) + doc[known], return_counts=True)
    term, local = pair // max(len(ids), 1), pair % max(len(ids), 1)
    place = term * (len(ids) // RANGE + 1) + local // RANGE
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    n_terms = len(words.dictionary)
    most, least = (np.maximum.reduceat(tf, begins), np.minimum.reduceat(lengths[local], begins)) if len(begins) else (tf, tf)
    arrays = {
        "ids": ids.astype(np.int64), "lengths": lengths.astype(np.int64), "lists": np.searchsorted(term, np.arange(n_terms + 1)).astype(np.int64), "local": local.astype(np.int32), "tf": tf.astype(np.int32),
        "blocks": np.searchsorted(term[begins], np.arange(n_terms + 1)).astype(np.int64), "ranges": (local[begins] // RANGE).astype(np.int32), "begins": np.append(begins, len(pair)).astype(np.int64), "most_tf": most.astype(np.int32), "least_dl": least.astype(np.int64),
    }
    return {c: a.tobytes() for c, a in arrays.items()} | {"terms": _ipc(words.dictionary.cast(pa.string()))}


def _indexed(shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard_docs):
                part = batch.slice(at, shard_docs)
                ids, lengths = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
                made = _inverted(ids, lengths, part.column(1))
                row = [[(task << 24) + n], [part.num_rows], [int(lengths.sum())], *([made[c]] for c in _COLUMNS)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 3 else pa.binary()) for i, x in enumerate(row)], ["shard", "n", "dl", *_COLUMNS])
                n += 1

    return run


def _places(row: dict, words: pa.Array) -> np.ndarray:
    """The number of each word's list in the shard; -1 for a word that it doesn't hold."""
    terms = pa.ipc.open_stream(row["terms"]).read_all().column("v").combine_chunks()
    return pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _frequencies(shared):
    """Dictionaries of shards -> documents that hold each word, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        df = np.zeros(len(words), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at, lists = _places(row, words), np.frombuffer(row["lists"], np.int64)
                df += np.where(at >= 0, np.append(np.diff(lists), 0)[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["word", "df"])

    return run


class _Shard:
    """A shard opened for some words; ``mean`` is the average length of the corpus."""

    def __init__(self, row: dict, words: pa.Array, mean: float, k1: float, b: float):
        kinds = {"local": np.int32, "tf": np.int32, "ranges": np.int32, "most_tf": np.int32}
        for c in _COLUMNS:
            if c != "terms":
                setattr(self, c, np.frombuffer(row[c], kinds.get(c, np.int64)))
        self.place, self.k1, self.b, self.mean = _places(row, words), k1, b, mean

    def part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """What a posting adds before the term's weight; it rises with tf and falls with dl."""
        return tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * (dl / self.mean)))

    def best(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: float, digits: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids and scores of the documents that may be among the k best and reach ``floor``; how many blocks
        were scored, and how many there are."""
        lists, weight = self.place[terms], weight[self.place[terms] >= 0]
        lists = lists[lists >= 0]
        size = self.blocks[lists + 1] - self.blocks[lists]
        block = np.repeat(self.blocks[lists] - np.cumsum(size) + size, size) + np.arange(size.sum())
        w, where = np.repeat(weight, size), self.ranges[block]
        bound = np.bincount(where, w * self.part(self.most_tf[block], self.least_dl[block]))
        reach = bound * (1.0 + (len(lists) + 8) * np.finfo(float).eps) + SLACK
        n = self.begins[block + 1] - self.begins[block]
        held = np.bincount(where, n)
        order, at, step, scored = np.argsort(-bound, kind="stable"), 0, 2, 0
        found, score = np.zeros(0, np.int64), np.zeros(0)
        while at < len(order) and bound[order[at]] > 0 and reach[order[at]] >= floor:
            piece = order[at : at + step]
            piece = piece[: max(1, int(np.searchsorted(np.cumsum(held[piece]), POSTINGS, side="right")))]
            chosen = np.zeros(len(bound), bool)
            chosen[piece] = True
            chosen &= reach >= floor
            on = np.flatnonzero(chosen[where])
            scored += len(on)
            post = np.repeat(self.begins[block[on]] - np.cumsum(n[on]) + n[on], n[on]) + np.arange(n[on].sum())
            local = self.local[post]
            total = np.bincount(local, np.repeat(w[on], n[on]) * self.part(self.tf[post], self.lengths[local]))
            new = np.flatnonzero(total > 0)
            found, score = np.concatenate([found, new]), np.concatenate([score, np.round(total[new], digits)])
            if len(score) >= k:
                floor = max(floor, float(np.partition(score, len(score) - k)[len(score) - k]))
            at, step = at + len(piece), 2 * step
        stays = (score >= floor) & (score > 0)
        return self.ids[found[stays]], score[stays], scored, len(block)


def _answered(shared, k: int, k1: float, b: float, digits: int, names: tuple[str, str], tally=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, terms, idf, mean = shared.value
        held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard(batch.slice(i, 1).to_pylist()[0], words, mean, k1, b)
                for q, mine in enumerate(terms):
                    key, score = held[q]
                    more, new, scored, blocks = shard.best(mine, idf[mine], k, score[k - 1] if len(score) >= k else 0.0, digits)
                    if tally is not None:
                        tally[0].add(scored)
                        tally[1].add(blocks)
                    if len(more):
                        key, score = np.concatenate([key, more]), np.concatenate([score, new])
                        order = np.lexsort((key, -score))[:k]
                        held[q] = key[order], score[order]
        n = [len(x[0]) for x in held]
        both = [np.concatenate([x[j] for x in held]) if held else np.zeros(0) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(float))], [*names, "score"])

    return run


class Postings:
    """The index of ``tokenized`` rows (key, terms, dl), computed and stored once. Keys are integers; rows that
    repeat a key are documents of their own."""

    def __init__(self, tokenized: DataFrame, key: str = "doc_id", shard_docs: int = 2048):
        self.key = key
        rows = tokenized.select(F.col(key).cast("bigint").alias(key), "terms", "dl")
        with rows_at_once(rows.sparkSession, shard_docs):
            self.shards = stored(rows.mapInArrow(_indexed(shard_docs), _SHARDS), "postings", **_WRITTEN)
        n, dl = self.shards.agg(F.sum("n"), F.sum("dl")).first()
        self.n, self.mean = n or 0, (dl or 0) / n if n and dl else 1.0

    def frequencies(self, words: pa.Array) -> np.ndarray:
        """Documents that hold each word, from the dictionaries alone."""
        shared = self.shards.sparkSession.sparkContext.broadcast(words)
        counts = self.shards.select("terms", "lists").mapInArrow(_frequencies(shared), "word bigint, df bigint")
        df = np.zeros(len(words), np.int64)
        with rows_at_once(self.shards.sparkSession, 1):
            for word, m in counts.groupBy("word").agg(F.sum("df")).collect():  # a row for each word of a block of queries
                df[word] = m
        shared.unpersist()
        return df

    def search(self, queries: DataFrame, k: int, query_key: str = "query_id", k1: float = 1.2, b: float = 0.75, digits: int = 9, query_block: int = 1024, tally=None, block_terms: int = BLOCK_TERMS) -> DataFrame:
        """query, document, score: candidates for the k best of each query, each score above zero. ``queries`` is
        (query, term), a row for each distinct term. They are a stated set, taken in blocks of at most
        ``query_block`` queries and ``block_terms`` terms, or of one query with more terms; a block holds its
        terms once and its queries as places of terms, and its answers are stored and its broadcast freed
        before the next. ``tally``, two accumulators, count the blocks that are scored and all blocks of the
        terms."""
        spark, done, last = self.shards.sparkSession, [], None
        spec = f"{query_key} bigint, {self.key} bigint, score double"
        by_query = cut(queries.groupBy(query_key).agg(F.array_sort(F.collect_set("term")).alias("terms")))
        while True:
            left = by_query if last is None else by_query.where(F.col(query_key) > last)
            sizes = left.select(query_key, F.size("terms")).orderBy(query_key).limit(query_block).collect()
            fit = max(1, int(np.searchsorted(np.cumsum([r[1] for r in sizes]), block_terms, side="right")))
            if sizes:
                last = sizes[:fit][-1][0]
                block = left.where(F.col(query_key).isNull() | (F.col(query_key) <= last)).collect()
                words = pa.array(sorted({t for r in block for t in r[1]}), pa.string())
                of = {t: i for i, t in enumerate(words.to_pylist())}
                df = self.frequencies(words)
                idf = np.log(1.0 + (self.n - df + 0.5) / (df + 0.5))
                asked = words, np.array([r[0] for r in block], np.int64), [np.array([of[t] for t in r[1]], np.int64) for r in block], idf, self.mean
                shared = spark.sparkContext.broadcast(asked)
                with rows_at_once(spark, 1):
                    done.append(cut(self.shards.mapInArrow(_answered(shared, k, k1, b, digits, (query_key, self.key), tally), spec)))
                shared.unpersist()
            if fit >= len(sizes) and len(sizes) < query_block:
                return reduce(DataFrame.unionAll, done) if done else spark.createDataFrame([], spec)
