"""Substring dedup by fixed-block anchors.

Reference blocks are the non-overlapping runs of ``block_words`` words of every document; a
window of ``window`` words always holds a whole block when block_words <= (window + 1) / 2.
Every rolling run of block_words words probes that index. Probes that meet a block of another
document mark the windows around them; those windows are extended to full length, compared by
64-bit hash within buckets of a second hash, and every window that starts in a smaller document
is removed. Runs of removed windows are the maximal exact repeats.

Documents are stored in blocks of some megabytes. A block probes once for each run that occurs in
it, names the smallest and largest document of its reference blocks, and sends of a window only
the occurrences in its smallest document; the others are decided at once. So a run or a window
that a third of all documents share costs a bucket one entry for each block of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import LARGE_ROWS
from . import exchange as ex
from . import textkit as tk
from .exchange import DOCS
from .workspace import Workspace, block_count

_TABLE, _SECOND = tk.byte_table(31), tk.U64(0x2545F4914F6CDD1D)
PROBES, REFERENCES, HITS, WINDOWS, MARKS = 1, 2, 3, 4, 5
#: Who holds a reference block that was met: several documents, or one.
_SEVERAL, _ONE = 0, 1


class Words:
    """Word hashes of a chunk with run hashes; ``doc`` is the document of each word."""

    def __init__(self, chunk: tk.Chunk):
        self.hash, self.starts, self.ends, self.doc = tk.word_sequence(chunk, _TABLE)
        self.count = tk.counts_by_doc(self.doc, chunk.n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.pre = tk.prefix(self.hash)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (word numbers in the chunk) and hashes of the runs of k words inside one document."""
        h = tk.rolling(self.pre, k) if len(self.hash) >= k else np.empty(0, tk.U64)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 : k - 1 + len(h)])
        return at, h[at]

    def second(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the runs of k words at these places that have nothing in common with those of ``runs``."""
        return tk.rolling(tk.prefix(tk.mix(self.hash + _SECOND)), k)[at]


class _Dedup:
    """The steps of one run, each from packed rows to packed rows."""

    def __init__(self, doc_id: str, text: str, window: int, block_words: int, buckets: int, fan: int | None):
        self.doc_id, self.text, self.window, self.block_words, self.buckets = doc_id, text, window, block_words, buckets
        route = lambda kind, *types: ex.Route(kind, buckets, *types, fan=fan)
        self.probes, self.references, self.hits = route(PROBES, np.uint32, np.uint8), route(REFERENCES, np.uint32, np.int64), route(HITS, np.uint32, np.uint8)
        self.windows, self.marks = route(WINDOWS, np.uint64, np.uint32), route(MARKS, np.uint32)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> tk.U64(32)) % tk.U64(self.buckets)).astype(np.int64)

    def probe(self, block: int, bodies: list[bytes]) -> pa.Table:
        """A block -> its distinct runs by bucket, and the smallest and largest document of its reference blocks."""
        b, parts = ex.Block(bodies, self.doc_id, self.text), []
        for chunk in tk.chunks(b.texts, 1 << 20):
            w = Words(chunk)
            at, h = w.runs(self.block_words)
            doc = w.doc[at]
            on = b.usable[chunk.first + doc]
            at, h, doc = at[on], h[on], doc[on]
            parts.append((h, b.ids[chunk.first + doc], (at - w.first[doc]) % self.block_words == 0))
        if not parts:
            return ex.rows_to_batch([])
        h, ids, reference = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(h):
            return ex.rows_to_batch([])
        order = np.argsort(h, kind="stable")
        h, ids, reference = h[order], ids[order], reference[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
        big = np.iinfo(np.int64)
        low, high = np.minimum.reduceat(np.where(reference, ids, big.max), cut), np.maximum.reduceat(np.where(reference, ids, big.min), cut)
        run = h[cut]
        none = np.zeros(len(run), np.int64)
        out = self.probes.send(self.bucket(run), none + block, none, none, run.astype(np.uint32), several.astype(np.uint8), part=block)
        held = np.flatnonzero(low <= high)
        # The smallest document goes as the record's id, the largest as a step from it.
        held = held[np.argsort(low[held], kind="stable")]
        return ex.rows_to_batch(out + self.references.send(self.bucket(run[held]), none[held] + block, low[held], none[held], run[held].astype(np.uint32), high[held] - low[held], part=block))

    def meet(self, key: int, kinds: dict) -> pa.Table:
        """A bucket -> for each block, its runs that met a reference block of another document, and whose that is."""
        home, low, _, run, step = ex.unpack(kinds.get(REFERENCES, []), *self.references.dtypes)
        block, _, _, probe, several = ex.unpack(kinds.get(PROBES, []), *self.probes.dtypes)
        if not len(run):
            return ex.rows_to_batch([])
        o = np.argsort(run, kind="stable")
        run, low, high, home = run[o], low[o], (low + step)[o], home[o]
        cut = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        run, low, high = run[cut], np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
        first, last = np.minimum.reduceat(home, cut), np.maximum.reduceat(home, cut)
        spot = np.minimum(np.searchsorted(run, probe), len(run) - 1)
        # A block that holds the only document of the reference blocks, and no other with this run, has met itself.
        hit = (run[spot] == probe) & ((low[spot] != high[spot]) | (several > 0) | (first[spot] != block) | (last[spot] != block))
        block, probe, spot = block[hit], probe[hit], spot[hit]
        owner = np.where(low[spot] == high[spot], low[spot], 0)
        o = np.lexsort((owner, block))
        block, probe, owner, one = block[o], probe[o], owner[o], (low[spot] == high[spot])[o]
        return ex.rows_to_batch(self.hits.send(block, block, owner, np.zeros(len(o), np.int64), probe, one.astype(np.uint8), part=key))

    def extend(self, key: int, kinds: dict) -> pa.Table:
        """Documents and their met runs -> the windows of each smallest document by bucket, and marks on the others."""
        if DOCS not in kinds or HITS not in kinds:
            return ex.rows_to_batch([])
        b = ex.Block(kinds[DOCS], self.doc_id, self.text)
        _, owner, _, probe, one = ex.unpack(kinds[HITS], *self.hits.dtypes)
        o = np.argsort(probe, kind="stable")
        probe, owner, one = probe[o], owner[o], one[o] > 0
        cut = np.flatnonzero(np.concatenate([[True], probe[1:] != probe[:-1]]))
        # Runs of equal 32 bits from several buckets: anybody's.
        alone = (np.diff(np.concatenate([cut, [len(probe)]])) == 1) & one[cut]
        probe, owner = probe[cut], owner[cut]
        parts = []
        for chunk in tk.chunks(b.texts, 1 << 20):
            w = Words(chunk)
            at, h = w.runs(self.block_words)
            on = b.usable[chunk.first + w.doc[at]]
            at, h = at[on], h[on].astype(np.uint32)
            spot = np.minimum(np.searchsorted(probe, h), len(probe) - 1)
            met = (probe[spot] == h) & ~(alone[spot] & (owner[spot] == b.ids[chunk.first + w.doc[at]]))
            flag = np.zeros(len(w.hash) + 1, np.int64)
            flag[1 + at[met]] = 1
            total = np.cumsum(flag)
            start, full = w.runs(self.window)
            some = total[start + self.window - self.block_words + 1] > total[start]
            start, full = start[some], full[some]
            doc = w.doc[start]
            parts.append((b.ids[chunk.first + doc], chunk.first + doc, full, w.second(self.window, start), (start - w.first[doc]).astype(np.uint32)))
        ids, rows, full, second, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        later = _later(ids, full, second)
        block, first = np.full(len(ids), key), np.flatnonzero(~later)
        out = self.windows.send(self.bucket(second[first]), block[first], ids[first], rows[first], full[first], start[first], part=key)
        later = np.flatnonzero(later)
        return ex.rows_to_batch(out + self.marks.send(block[later], block[later], ids[later], rows[later], start[later], part=key))

    def judge(self, key: int, kinds: dict) -> pa.Table:
        """A bucket of windows -> for each block, the windows that start in a smaller document."""
        block, ids, rows, full, start = ex.unpack(kinds.get(WINDOWS, []), *self.windows.dtypes)
        later = np.flatnonzero(_later(ids, full))
        later = later[np.lexsort((start[later], rows[later], block[later]))]
        return ex.rows_to_batch(self.marks.send(block[later], block[later], ids[later], rows[later], start[later], part=key))

    def remove(self, columns: list[str]):
        """Documents and their removed windows -> the documents with n_words, n_removed and kept."""

        def work(_: int, kinds: dict) -> pa.Table:
            b = ex.Block(kinds[DOCS], self.doc_id, self.text)
            _, _, rows, start = ex.unpack(kinds.get(MARKS, []), *self.marks.dtypes)
            o = np.argsort(rows, kind="stable")
            rows, start = rows[o], start[o].astype(np.int64)
            counts, removed, kept = [], [], []
            for chunk in tk.chunks(b.texts):
                w = Words(chunk)
                doc, k = b.marks(chunk, rows)
                step = np.zeros(len(w.hash) + 1, np.int64)
                at = w.first[doc] + start[k]
                np.add.at(step, at, 1)
                np.add.at(step, at + self.window, -1)
                gone = np.cumsum(step[:-1]) > 0
                counts.append(w.count)
                removed.append(tk.counts_by_doc(w.doc[gone], chunk.n))
                kept.append(joined_words(chunk, w.starts[~gone], w.ends[~gone], w.doc[~gone]))
            out = b.table.select(columns)
            for name, value in (("n_words", counts), ("n_removed", removed)):
                out = out.append_column(name, pa.array(np.concatenate(value) if value else np.zeros(0, np.int64), pa.int64()))
            return out.append_column("kept", pa.chunked_array(kept, pa.string()))

        return work


def _later(ids: np.ndarray, *name: np.ndarray) -> np.ndarray:
    """Which windows are also in a document of a smaller id."""
    if not len(ids):
        return np.zeros(0, bool)
    order = np.lexsort(name)
    new = np.zeros(len(order), bool)
    new[0] = True
    for x in name:
        new[1:] |= x[order][1:] != x[order][:-1]
    cut = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids[order], cut), np.diff(np.concatenate([cut, [len(order)]])))
    out = np.zeros(len(ids), bool)
    out[order] = ids[order] > least
    return out


def joined_words(chunk: tk.Chunk, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The given words of each document joined by one space."""
    size = ends - starts
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    room = size + ~last
    offset = np.concatenate([[0], np.cumsum(room)])
    inside = np.arange(int(offset[-1])) - np.repeat(offset[:-1], room)
    out = np.full(int(offset[-1]), 32, np.uint8)
    letter = inside < np.repeat(size, room)
    out[letter] = chunk.data[(np.repeat(starts, room) + inside)[letter]]
    per_doc = np.bincount(doc, room, minlength=chunk.n).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(chunk.n, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, block_words: int | None = None, block_bytes: int = 4 << 20, fan: int | None = None) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept (the words that stay, one space between).

    A word goes if a window of ``window`` words that covers it also starts in a document of a
    smaller id. Windows are judged on the input. A null text has no words; an empty table gives no
    row; a very long text is a block of its own. Rows of one id are one document, with one text or
    several; a row with a null id is left whole and compared with nothing. An input column with one
    of the three names is replaced; other names don't matter.
    """
    block_words = block_words or (window + 1) // 2
    if not 1 <= 2 * block_words - 1 <= window:
        raise ValueError("a window must hold a whole reference block")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    docs = docs.select(*names).withColumn(doc_id, F.col(doc_id).cast("bigint"))
    n = block_count(docs, text, block_bytes)
    space, d = Workspace(docs.sparkSession, "substring"), _Dedup(doc_id, text, window, block_words, n, fan)
    blocks = space.write(ex.blocked(docs, text, block_bytes), "blocks", **LARGE_ROWS)
    probes = ex.each_block(blocks, d.probe)
    hits = space.write(ex.exchanged(ex.arrived(probes, d.probes, d.references), n, d.meet), "hits")
    del probes
    space.release()
    windows = space.write(ex.exchanged(blocks.unionByName(d.hits.arrive(hits)), n, d.extend), "windows", partition_by="kind")
    space.release()
    judged = space.write(ex.exchanged(d.windows.arrive(windows), n, d.judge), "judged")
    space.release()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint, n_removed bigint, kept string"])
    return ex.exchanged(blocks.unionByName(d.marks.arrive(windows.unionByName(judged))), n, d.remove(names), schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", ex.sha256_column("kept").alias("kept_sha256"))


#: Window by window; for small tables.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, s, md5_number(array_to_string(ws[s:s + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w)
), f AS (
  SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)
), later AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER o + 13 THEN 0 ELSE 1 END AS fresh FROM g JOIN f USING (h) WHERE doc_id > first WINDOW o AS (PARTITION BY doc_id ORDER BY s)
), spans AS (
  SELECT doc_id, min(s) AS lo, max(s) + 12 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM later) GROUP BY doc_id, n
), t AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT t.doc_id, string_agg(ws[i], ' ' ORDER BY i) AS kept, count(*) AS n FROM t
  WHERE NOT EXISTS (SELECT 1 FROM spans WHERE spans.doc_id = t.doc_id AND i BETWEEN lo AND hi) GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
