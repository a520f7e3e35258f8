"""Ranked lexical search over dual-sorted wavelet trees, one for each shard of documents.

A shard lays the posting lists of all its terms end to end, each list in the order of impact. A
wavelet tree over the document numbers of that one sequence sorts it the other way as well: a node
stands for a range of documents, a list is a range of places at every node, and within a node its
postings still lie in the order of impact. So the first posting of a list's range at a node is the
most that the list can add to any document below it, and the sum over a query's lists bounds every
score there. Search goes best node first, down to single documents, whose bounds are their scores,
and leaves every node whose bound is below the k-th score found: the result is exact.

The index is a table of shards in the shared folder, built as documents lie, without a shuffle. A
task keeps k documents a query and carries its k-th score from shard to shard; a few seed shards are
searched first, and their k-th scores are a floor for all others. The tree is stored level by level
(a bit for each posting, zeros before ones), so that a range moves down by counting bits.

Terms are told apart by 64-bit hashes within a shard, and a query's term meets them by its bytes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import LARGE_ROWS, rows_at_once
from . import textkit as tk
from .workspace import Workspace

_TABLE = tk.byte_table(31)
#: Bytes of a term: digits, letters, and all of characters beyond ASCII.
TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SHARD = "shard bigint, doc_ids binary, hashes binary, starts binary, ends binary, terms binary, impacts binary, bits binary"
_HITS = "item_id bigint, doc_id bigint, score bigint"


def item_terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return _TERMS.findall((text or "").encode().lower())


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Hashes of terms that lie one after the other, a piece of the data at a time: prefix sums and powers take
    many times the bytes that they stand for."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        pre = tk.prefix(_TABLE[tk.LOWER[data[starts[at] : ends[to - 1]]]])
        out[at:to] = tk.span_hash(pre, starts[at:to] - starts[at], ends[at:to] - starts[at])
        at = to
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and all their terms, of a task."""
    docs = terms = 0
    for b in batches:
        for chunk in tk.chunks(b.column(0)):
            _, _, doc = tk.runs(TERM[chunk.data], chunk.bounds)
            docs, terms = docs + len(np.unique(doc)), terms + len(doc)
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["n", "l"])


# --- a shard -----------------------------------------------------------------------------------


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What one occurrence of a term in a query adds for a posting, before the term's weight: integers
    below a million, by the number of times in the document and the document's length."""
    if int(n.max(initial=0)) * 75 * docs < 2**63:
        m = 25 + (75 * n * docs) // terms
    else:
        m = np.array([25 + (75 * int(x) * docs) // terms for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(chunk: tk.Chunk, docs: int, terms: int) -> tuple[np.ndarray, ...]:
    """Of a chunk: hashes of its terms, ascending; where each first occurs (start and end in bytes); where its
    list begins; and the document and impact of every posting, by list, impact (falling) and document."""
    starts, ends, doc = tk.runs(TERM[chunk.data], chunk.bounds)
    hashes, first, term = np.unique(_hashed(chunk.data, starts, ends), return_index=True, return_inverse=True)
    key = np.sort(term.astype(np.int64) * chunk.n + doc)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    term, doc_of, tf = key[cut] // max(chunk.n, 1), key[cut] % max(chunk.n, 1), np.diff(np.concatenate([cut, [len(key)]]))
    impact = impacts(tf, np.bincount(doc, minlength=chunk.n)[doc_of], docs, terms)
    order = np.lexsort((doc_of, -impact, term))
    return hashes, starts[first], ends[first], np.searchsorted(term, np.arange(len(hashes) + 1)), doc_of[order], impact[order]


def _levels(values: np.ndarray, depth: int) -> list[np.ndarray]:
    """The bits of a wavelet tree, level by level from the highest; every level is dealt out by the one before."""
    out = []
    for level in range(depth):
        bit = (values >> (depth - 1 - level) & 1).astype(bool)
        out.append(bit)
        values = np.concatenate([values[~bit], values[bit]])
    return out


def _depth(n: int) -> int:
    return max(1, (n - 1).bit_length())


def _built(docs: int, terms: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for chunk in tk.chunks(batch.column(1), shard_bytes, 1 << 16):
                hashes, starts, ends, lists, doc, impact = postings(chunk, docs, terms)
                data = tk.LOWER[chunk.data]
                words = b"".join(data[a:b].tobytes() for a, b in zip(starts, ends, strict=True))
                bits = b"".join(np.packbits(x).tobytes() for x in _levels(doc, _depth(chunk.n)))
                ids = batch.column(0).slice(chunk.first, chunk.n).to_numpy(zero_copy_only=False).astype(np.int64)
                parts = [tk.packed(ids), tk.packed(hashes), tk.packed(lists.astype(np.int64)), tk.packed(np.cumsum(ends - starts)), words, tk.packed(impact.astype(np.int32)), bits]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + n]), *(pa.array([x], pa.binary()) for x in parts)], [f.split()[0] for f in _SHARD.split(", ")])
                n += 1

    return run


class Dictionary:
    """The terms of a shard: hashes, where their lists begin, and their bytes."""

    def __init__(self, row: dict):
        self.hashes, self.starts, self.ends = (tk.unpacked(row[c], t) for c, t in (("hashes", np.uint64), ("starts", np.int64), ("ends", np.int64)))
        self.words = row["terms"]

    def lists(self, hashes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins and ends in the shard; both 0 for a term it doesn't hold."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        on = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        for i in np.flatnonzero(on):
            on[i] = self.words[self.ends[at[i] - 1] if at[i] else 0 : self.ends[at[i]]] == words[i]
        return np.where(on, self.starts[at], 0), np.where(on, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)


class Shard(Dictionary):
    """A shard in memory. ``zeros`` counts the zero bits before each place of a level; ``impact`` has the impacts
    in the order of each level, the leaves' last."""

    def __init__(self, row: dict):
        super().__init__(row)
        self.ids = tk.unpacked(row["doc_ids"], np.int64)
        here = tk.unpacked(row["impacts"], np.int32) if row["impacts"] else np.zeros(0, np.int32)
        n, self.depth = len(here), _depth(len(self.ids))
        size = -(-n // 8)
        self.zeros, self.impact = np.zeros((self.depth, n + 1), np.int32), np.empty((self.depth + 1, n), np.int32)
        for level in range(self.depth):
            bit = np.unpackbits(np.frombuffer(row["bits"], np.uint8, size, level * size), count=n).astype(bool)
            np.cumsum(~bit, out=self.zeros[level, 1:])
            self.impact[level] = here
            here = np.concatenate([here[~bit], here[bit]])
        self.impact[self.depth] = here

    def best(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, k: int, floor: int, tally=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents that may be among the k best, and of all that reach both
        ``floor`` and the k-th score. ``tally`` counts the nodes that are visited."""
        some = (hi > lo) & (weight > 0)
        pool = [x[some].astype(np.int64) for x in (lo, hi, weight)]  # lists of nodes, node by node
        nodes = np.array([[0, 0, 0, len(pool[0]), self._bound(0, pool[0], pool[2], np.zeros(1, np.int64))[0] if some.any() else 0]])  # level, documents, lists from, to, bound
        found, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            nodes = nodes[nodes[:, 4] >= floor]
            if not len(nodes):
                return self.ids[found[score >= floor]], score[score >= floor]
            most = max(32, len(nodes) // 4)
            if len(nodes) > most:
                order = np.argpartition(nodes[:, 4], len(nodes) - most)
                picked, nodes = nodes[order[-most:]], nodes[order[:-most]]
            else:
                picked, nodes = nodes, nodes[:0]
            if tally is not None:
                tally.add(len(picked))
            leaf = picked[:, 0] == self.depth
            if leaf.any():
                found, score = np.concatenate([found, picked[leaf, 1]]), np.concatenate([score, picked[leaf, 4]])
                if len(score) >= k:
                    floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
            below, pool = self._split(picked[~leaf], pool, floor)
            nodes = np.concatenate([nodes, below])
            if len(pool[0]) > 1 << 20 and 2 * int((nodes[:, 3] - nodes[:, 2]).sum()) < len(pool[0]):
                pool = [x[self._spread(nodes)[1]] for x in pool]
                nodes[:, 3] = np.cumsum(nodes[:, 3] - nodes[:, 2])
                nodes[:, 2] = np.concatenate([[0], nodes[:-1, 3]])

    def _bound(self, level, lo: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Sums of weight times the first impact of each list, for nodes whose lists begin at ``cuts``."""
        return np.add.reduceat(weight * self.impact[level, lo], cuts)

    @staticmethod
    def _spread(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every list of some nodes: its node, and its place in the pool."""
        size = nodes[:, 3] - nodes[:, 2]
        return np.repeat(np.arange(len(nodes)), size), np.repeat(nodes[:, 2] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def _split(self, nodes: np.ndarray, pool: list[np.ndarray], floor: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Both children of each node, without those whose bound is under the floor; their lists join the pool."""
        made, parts, size = [nodes[:0]], [pool], len(pool[0])
        if not len(nodes):
            return nodes, pool
        node, at = self._spread(nodes)
        lo, hi, weight = (x[at] for x in pool)
        level = nodes[node, 0]
        z_lo, z_hi = self.zeros[level, lo].astype(np.int64), self.zeros[level, hi].astype(np.int64)
        for side, (a, b) in enumerate(((z_lo, z_hi), (self.zeros[level, -1] + lo - z_lo, self.zeros[level, -1] + hi - z_hi))):
            on = np.flatnonzero(b > a)
            if not len(on):
                continue
            of, a, b, w = node[on], a[on], b[on], weight[on]
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            bound = self._bound(level[on] + 1, a, w, cuts)
            ends = np.concatenate([cuts[1:], [len(of)]])
            up = nodes[of[cuts]]
            child = np.stack([up[:, 0] + 1, 2 * up[:, 1] + side, size + cuts, size + ends, bound], axis=1)
            made.append(child[bound >= floor])
            parts.append([a, b, w])
            size += len(of)
        return np.concatenate(made), [np.concatenate(x) for x in zip(*parts, strict=True)]


# --- queries -----------------------------------------------------------------------------------


class Ask:
    """A block of queries: its distinct terms, and for each query the places of its terms and how often it has them."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, each = [i for i, _ in items], [Counter(item_terms(t)) for _, t in items]
        self.words = sorted({w for c in each for w in c})
        place = {w: i for i, w in enumerate(self.words)}
        self.terms = [np.array([place[w] for w in c], np.int64) for c in each]
        self.times = [np.array(list(c.values()), np.int64) for c in each]
        ends = np.cumsum([len(w) for w in self.words]).astype(np.int64)
        data = np.frombuffer(b"".join(self.words), np.uint8)
        self.hashes = _hashed(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if self.words else np.zeros(0, np.uint64)
        self.weight = np.zeros(len(self.words), np.int64)


def _counted(shared):
    """Dictionaries of shards -> how many documents hold each term of the queries, summed in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = shared.value
        df = np.zeros(len(ask.words), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                lo, hi = Dictionary(batch.slice(i, 1).to_pylist()[0]).lists(ask.hashes, ask.words)
                df += hi - lo
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    return run


def _searched(shared, k: int, tally=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, floors = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ask.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                lo, hi = shard.lists(ask.hashes, ask.words)
                for q, (terms, times) in enumerate(zip(ask.terms, ask.times, strict=True)):
                    ids, score = held[q]
                    floor = max(1, floors[q], int(score[k - 1]) if len(score) >= k else 0)
                    more, new = shard.best(lo[terms], hi[terms], ask.weight[terms] * times, k, floor, tally)
                    if len(more):
                        ids, score = np.concatenate([ids, more]), np.concatenate([score, new])
                        order = np.lexsort((ids, -score))[:k]
                        held[q] = ids[order], score[order]
        q = np.repeat(np.array(ask.ids, np.int64), [len(x[0]) for x in held])
        yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate([np.zeros(0, np.int64), *(x[j] for x in held)])) for j in (0, 1))], ["item_id", "doc_id", "score"])

    return run


def _in_blocks(rows: Iterator, most: int, most_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for item_id, text in rows:
        if block and (len(block) >= most or size + len(text or "") > most_bytes):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text or "")
    if block:
        yield block


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class WaveletIndex:
    """The index of all rows of ``docs`` that have an id, as a table of shards.

    A null or empty text has no terms, and only counts in nothing. Rows that repeat an id are
    documents of their own. An empty table gives an index without shards. A very long text is a shard of
    its own, so that it costs a task memory in proportion to it. Only id and text are read.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 8_000_000):
        self.spark = docs.sparkSession
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        size = rows.select("text").mapInArrow(_lengths, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
        self.docs, self.terms = size[0] or 0, size[1] or 0
        self.space = Workspace(self.spark, "wavelet")
        self.shards = self.space.write(rows.mapInArrow(_built(self.docs, max(self.terms, 1), shard_bytes), _SHARD), "shards", **LARGE_ROWS)

    def weighted(self, items: list[tuple[int, str | None]]) -> Ask:
        """The queries with the weights of their terms, whose document frequencies come from the dictionaries."""
        ask = Ask(items)
        shared = self.spark.sparkContext.broadcast(ask)
        found = self.shards.select("hashes", "starts", "ends", "terms").mapInArrow(_counted(shared), "term bigint, df bigint")
        # One row for each term of the block of queries.
        with rows_at_once(self.spark, 1):
            df = dict(found.groupBy("term").agg(F.sum("df")).collect())
        shared.unpersist()
        ask.weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(ask.words))], np.int64)
        return ask

    def search(self, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", block_items: int = 1024, block_bytes: int = 1 << 21, seeds: int = 32, tally=None) -> DataFrame:
        """item_id, rank, doc_id, score: for each query its k documents of the highest score above 0, equal
        scores by ascending doc_id.

        A query without an id takes no part, one without terms has no row; rows of one id are one query,
        that of the smallest text. The queries are a stated set, taken in blocks of at most ``block_items``
        or ``block_bytes`` of text (a longer one is a block of its own); a block's answers are written before
        the next. One shard in ``seeds`` is searched first for a floor."""
        stated = queries.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).cast("bigint").alias("item_id")).agg(F.min(text).alias("text"))
        stated = self.space.write(stated.orderBy("item_id"), "queries")
        n, seed = 0, F.pmod(F.xxhash64("shard"), F.lit(seeds)) == 0
        for items in _in_blocks(stated.orderBy("item_id").toLocalIterator(), block_items, block_bytes):
            ask = self.weighted(items)
            floors, at = np.zeros(len(items), np.int64), {q: i for i, q in enumerate(ask.ids)}
            first = self.spark.sparkContext.broadcast((ask, floors))
            some = _ranked(self.shards.where(seed).mapInArrow(_searched(first, k, tally), _HITS), k)
            with rows_at_once(self.spark, 1):
                # One score a query of the block.
                for q, score in some.where(F.col("rank") == k).select("item_id", "score").collect():
                    floors[at[q]] = score
                second = self.spark.sparkContext.broadcast((ask, floors))
                found = _ranked(self.shards.mapInArrow(_searched(second, k, tally), _HITS), k)
                self.space.write(found.select("item_id", "rank", "doc_id", "score"), f"answers/block={n}")
            first.unpersist()
            second.unpersist()
            n += 1
        schema = "item_id bigint, rank int, doc_id bigint, score bigint"
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", block int").parquet(self.space.path("answers")).drop("block")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    index = WaveletIndex(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), n AS (
  SELECT doc_id, count(*) AS n FROM t GROUP BY ALL
), c AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs
), i AS (
  SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark
), q AS (
  SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL
), s AS (
  SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n ON n.doc_id = p.doc_id, c GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
