"""Suffix-array dedup by longest-previous-factor arrays.

In suffix order, the earlier text that shares the longest prefix with a position is its
previous or its next smaller position. A position whose longest previous factor reaches the
threshold starts a repeat; the bytes it covers go, and the first copy stays. ``repeats`` is that
test; every removal below is its answer.

One suffix array over a corpus does not distribute, so suffixes are dealt out by content. Names
stand for long strings, as ranks do in prefix doubling: equal names, equal strings.

1. Every ``length``-byte string holds a minimiser, the least hashed ``anchor``-gram in it, which
   its copies choose alike. An anchor's context is the bytes that strings around it can reach;
   hash and context are its 128-bit name. A block of documents sends the first position of each
   name to a bucket of the name. There the factors of whole contexts are known: a later position
   of a name is a repeat as a whole, and the first one goes on.
2. Anchors whose hash has several contexts may share a part of them. Buckets count the contexts of
   each hash, and counts are added up by hash, so that a frequent anchor is one number a bucket.
3. Such contexts are cut out of their documents and meet by hash. Their suffixes are sorted by
   prefix doubling, and their factors decide. The suffixes of an anchor with more contexts than a
   slice of ``slice_bytes`` holds are named one by one, and dealt by name to all buckets, of each
   name the first one of a block only.
4. Marks meet their documents again, and the marked bytes are taken out.
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

_TABLE, _SECOND = tk.byte_table(41), tk.byte_table(43)
FOUND, SPANS, FIRST, COUNTS, SEVERAL, ASKED, CONTEXTS, NAMED = 1, 2, 3, 4, 5, 6, 7, 8
_TOP = tk.U64(2**64 - 1)
#: Bytes of text that a step takes at once, but for longer texts; finding anchors holds a hundred bytes for each.
CHUNK_BYTES = 1 << 19


# --- suffix order and previous factors ---------------------------------------------------------


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by several keys, equal rows alike, from 0."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int32 if len(order) < 2**31 else np.int64)
    rank[order] = np.cumsum(new, dtype=rank.dtype)
    return rank


def prefix_ranks(data: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with at least ``length`` bytes of room and the ranks of their length-byte
    prefixes, by prefix doubling. ``room[i]`` is the number of bytes from i to the end of its text."""
    step = min(8, length)
    at = np.flatnonzero(room >= step)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data),), ">u8", padded, strides=(1,))[at].astype(np.uint64)
    word >>= tk.U64(64 - 8 * step)
    new = _dense(word)
    del word
    rank = np.zeros(len(data), new.dtype)
    rank[at] = new
    while step < length:
        to = min(2 * step, length)
        at = at[room[at] >= to]
        pair = rank[at] * np.int64(len(data) + 1)
        pair += rank[at + (to - step)]
        rank[at] = _dense(pair)  # places without room keep an old rank, and no later step reads them
        step = to
    return at, rank[at]


def repeats(at: np.ndarray, rank: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Which positions have a longest previous factor that reaches the length that ``rank`` ranks.

    ``age`` is the order of the positions in the corpus. Along the suffix order, runs of equal rank
    are the neighbours whose common prefix reaches the length; within a run a position has a previous
    or next smaller one exactly where the running minimum from one of the two sides is below it.
    """
    order = np.argsort(rank, kind="stable")
    r, a = rank[order], age[order]
    if not len(r):
        return np.zeros(0, bool)
    same = r[1:] == r[:-1]
    # Runs get falling or rising offsets, so that one running minimum serves all of them.
    run = np.concatenate([[0], np.cumsum(~same)]) * (np.int64(a.max()) + 1)
    smaller = np.zeros(len(at), bool)
    key = a - run
    smaller[1:] = (np.minimum.accumulate(key)[:-1] < key[1:]) & same
    key = a + run
    smaller[:-1] |= (np.minimum.accumulate(key[::-1])[::-1][1:] < key[:-1]) & same
    out = np.zeros(len(at), bool)
    out[order] = smaller
    return out


def named(ids: np.ndarray, place: np.ndarray, *name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first positions of each name, and of those with a previous factor: by (id, place).
    Positions of one age are first or later together."""
    rank = _dense(*name)
    later = repeats(rank, rank, _dense(ids, place))
    return np.flatnonzero(~later), np.flatnonzero(later)


# --- anchors -----------------------------------------------------------------------------------


def anchors(chunk: tk.Chunk, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Places, hashes, documents and context bounds of the minimisers of all length-byte strings."""
    n, w = len(chunk.data), length - anchor + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, np.empty(0, tk.U64), none, np.empty(0, tk.U64), (none, none)
    pre = tk.prefix(_TABLE[chunk.data])
    h = tk.rolling(pre, anchor)
    size = np.diff(chunk.bounds)
    valid = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(size >= length)
    np.add.at(valid, chunk.bounds[long], 1)
    np.add.at(valid, chunk.bounds[long + 1] - length + 1, -1)
    valid = np.cumsum(valid[: n - length + 1]) > 0
    least = tk.sliding_min(h, w)[: len(valid)]
    # A place is an anchor where the largest window minimum over the valid windows around it is its own hash.
    low = np.where(valid, ~least, _TOP)
    padded = np.concatenate([np.full(w - 1, _TOP), low, np.full(w - 1, _TOP)])
    at = np.flatnonzero(~tk.sliding_min(padded, w)[: len(h)] == h)
    doc = np.searchsorted(chunk.bounds, at, side="right") - 1
    some = size[doc] >= length
    at, doc = at[some], doc[some]
    lo = np.maximum(at - (length - anchor), chunk.bounds[doc])
    hi = np.minimum(at + length, chunk.bounds[doc + 1])
    context = tk.mix(tk.span_hash(pre, lo, hi) + ((at - lo) * 1021 + (hi - at)).astype(np.uint64))
    return at, h[at], doc, context, (lo, hi)


def _joined(parts: list[tuple], types: tuple) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in types]


class _Dedup:
    """The steps of one run, each from packed rows to packed rows."""

    def __init__(self, doc_id: str, text: str, length: int, anchor: int, buckets: int, slice_bytes: int, fan: int | None):
        self.doc_id, self.text, self.length, self.anchor, self.buckets, self.slice_bytes = doc_id, text, length, anchor, buckets, slice_bytes
        #: Contexts of an anchor that one slice holds.
        self.contexts = max(1, slice_bytes // (2 * length))
        route = lambda kind, *types: ex.Route(kind, buckets, *types, fan=fan)
        self.found, self.first = route(FOUND, np.uint64, np.uint64, np.uint32), route(FIRST, np.uint64, np.uint32)
        self.spans, self.asked = route(SPANS, np.uint32, np.uint32), route(ASKED, np.uint32, np.uint64, np.uint32)
        self.counts, self.several = route(COUNTS, np.uint64, np.uint32), route(SEVERAL, np.uint64, np.uint32)
        self.named = route(NAMED, np.uint64, np.uint64, np.uint32)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (tk.mix(h) % tk.U64(self.buckets)).astype(np.int64)

    def send_spans(self, block, ids, rows, lo, hi, part: int) -> list:
        """Marks to their blocks; neighbouring and overlapping spans of a document become one."""
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        o = np.lexsort((lo, rows, block))
        block, ids, rows, lo, hi = block[o], ids[o], rows[o], lo[o], hi[o]
        if not len(o):
            return []
        doc = np.cumsum(np.concatenate([[0], (block[1:] != block[:-1]) | (rows[1:] != rows[:-1])])).astype(np.int64)
        far = doc * np.int64(hi.max() + 1)
        reach = np.maximum.accumulate(hi + far)
        begin = np.flatnonzero(np.concatenate([[True], (lo + far)[1:] > reach[:-1]]))
        end = np.concatenate([begin[1:], [len(o)]]) - 1
        return self.spans.send(block[begin], block[begin], ids[begin], rows[begin], lo[begin].astype(np.uint32), (reach[end] - far[end]).astype(np.uint32), part=part)

    def whole(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of an anchor's context; the end may pass that of the document."""
        pos = pos.astype(np.int64)
        return np.maximum(pos - (self.length - self.anchor), 0), pos + self.length

    def find(self, block: int, bodies: list[bytes]) -> pa.Table:
        """A block -> its first anchors by bucket of their names, and spans that repeat inside the block."""
        b, parts = ex.Block(bodies, self.doc_id, self.text), []
        for chunk in tk.chunks(b.texts, CHUNK_BYTES):
            at, h, doc, context, _ = anchors(chunk, self.length, self.anchor)
            on = b.usable[chunk.first + doc]
            at, h, doc, context = at[on], h[on], doc[on], context[on]
            parts.append((b.ids[chunk.first + doc], chunk.first + doc, h, context, (at - chunk.bounds[doc]).astype(np.uint32)))
        ids, rows, h, context, pos = _joined(parts, (np.int64, np.int64, np.uint64, np.uint64, np.uint32))
        first, again = named(ids, pos, h, context)
        at = np.full(len(ids), block)
        out = self.send_spans(at[again], ids[again], rows[again], *self.whole(pos[again]), block)
        return ex.rows_to_batch(out + self.found.send(self.bucket(h[first] ^ tk.mix(context[first])), at[first], ids[first], rows[first], h[first], context[first], pos[first], part=block))

    def meet(self, key: int, kinds: dict) -> pa.Table:
        """A bucket of names -> spans of the later positions; the first ones, kept by this bucket; how many contexts each hash has.
        Spans that a block found by itself pass through."""
        passing = [(SPANS, key, i % ex.PARTS, body) for i, body in enumerate(kinds.get(SPANS, []))]
        if FOUND not in kinds:
            return ex.rows_to_batch(passing)
        block, ids, rows, h, context, pos = ex.unpack(kinds[FOUND], *self.found.dtypes)
        first, again = named(ids, pos, h, context)
        out = passing + self.send_spans(block[again], ids[again], rows[again], *self.whole(pos[again]), key)
        block, ids, rows, h, context, pos = (x[first] for x in (block, ids, rows, h, context, pos))
        o = np.lexsort((pos, rows, block))
        out += self.first.send(np.full(len(o), key), block[o], ids[o], rows[o], h[o], pos[o], part=key)
        o = np.lexsort((context, h))
        new = np.concatenate([[True], (h[o][1:] != h[o][:-1]) | (context[o][1:] != context[o][:-1])]) if len(o) else np.zeros(0, bool)
        hashes, n = np.unique(h[o][new], return_counts=True)
        none = np.zeros(len(hashes), np.int64)
        return ex.rows_to_batch(out + self.counts.send(self.bucket(hashes), none + key, none, none, hashes, n.astype(np.uint32), part=key))

    def add(self, key: int, kinds: dict) -> pa.Table:
        """Counts by hash -> to each bucket of names that holds one of several contexts, their number."""
        bucket, _, _, h, n = ex.unpack(kinds.get(COUNTS, []), *self.counts.dtypes)
        hashes, place = np.unique(h, return_inverse=True)
        total = np.bincount(place, n, minlength=len(hashes)).astype(np.int64)[place]
        on = np.flatnonzero(total > 1)
        on = on[np.argsort(bucket[on], kind="stable")]
        none = np.zeros(len(on), np.int64)
        return ex.rows_to_batch(self.several.send(bucket[on], none, none, none, h[on], np.minimum(total[on], 2**32 - 1).astype(np.uint32), part=key))

    def ask(self, key: int, kinds: dict) -> pa.Table:
        """First positions and the hashes that have several contexts -> the positions whose contexts are asked for, by block."""
        _, _, _, hashes, total = ex.unpack(kinds.get(SEVERAL, []), *self.several.dtypes)
        if not len(hashes) or FIRST not in kinds:
            return ex.rows_to_batch([])
        block, ids, rows, h, pos = ex.unpack(kinds[FIRST], *self.first.dtypes)
        o = np.argsort(hashes)
        hashes, total = hashes[o], total[o]
        spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        on = np.flatnonzero(hashes[spot] == h)
        return ex.rows_to_batch(self.asked.send(block[on], block[on], ids[on], rows[on], pos[on], h[on], total[spot[on]], part=key))

    def extract(self, key: int, kinds: dict) -> pa.Table:
        """Documents and asked anchors -> contexts by bucket of the anchor; of frequent anchors, each suffix by its name."""
        if DOCS not in kinds or ASKED not in kinds:
            return ex.rows_to_batch([])
        b = ex.Block(kinds[DOCS], self.doc_id, self.text)
        _, _, rows, pos, h, total = ex.unpack(kinds[ASKED], *self.asked.dtypes)
        o = np.argsort(rows, kind="stable")
        rows, h, total = rows[o], h[o], total[o]
        lo, hi = self.whole(pos[o])
        few, contexts, suffixes = total <= self.contexts, [], []
        for chunk in tk.chunks(b.texts, CHUNK_BYTES):
            k = np.arange(np.searchsorted(rows, chunk.first), np.searchsorted(rows, chunk.first + chunk.n))
            base, end = chunk.bounds[rows[k] - chunk.first], np.diff(chunk.bounds)[rows[k] - chunk.first]
            a, z = lo[k], np.minimum(hi[k], end)
            on = few[k]
            if on.any():
                room = (z - a)[on]
                at = np.repeat((base + a)[on] - (np.cumsum(room) - room), room) + np.arange(room.sum())
                contexts.append((rows[k[on]], a[on], room, h[k[on]], chunk.data[at]))
            on = ~on
            if on.any():
                n = np.maximum((z - a)[on] - self.length + 1, 0)
                start = np.repeat((base + a)[on] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                start = np.unique(start)
                doc = np.searchsorted(chunk.bounds, start, side="right") - 1
                names = [tk.span_hash(tk.prefix(t[chunk.data]), start, start + self.length) for t in (_TABLE, _SECOND)]
                suffixes.append((chunk.first + doc, (start - chunk.bounds[doc]).astype(np.uint32), *names))
        out = []
        if contexts:
            rows, start, room, h, data = (np.concatenate(x) for x in zip(*contexts, strict=True))
            offset = np.concatenate([[0], np.cumsum(room)])
            for p, k in ex.split(self.bucket(h)):
                at = np.repeat(offset[k] - (np.cumsum(room[k]) - room[k]), room[k]) + np.arange(room[k].sum())
                t = pa.table({"block": np.full(len(k), key), "id": b.ids[rows[k]], "row": rows[k], "start": start[k], "h": h[k]})
                out.append((CONTEXTS, p, key % ex.PARTS, ex.to_ipc(t.append_column("data", pa.array(_slices(data[at], room[k]), pa.binary())))))
        if suffixes:
            rows, pos, *names = (np.concatenate(x) for x in zip(*suffixes, strict=True))
            first, again = named(b.ids[rows], pos, *names)
            at = np.full(len(rows), key)
            out += self.send_spans(at[again], b.ids[rows[again]], rows[again], pos[again], pos[again].astype(np.int64) + self.length, key)
            out += self.named.send(self.bucket(names[0][first]), at[first], b.ids[rows[first]], rows[first], *(x[first] for x in names), pos[first], part=key)
        return ex.rows_to_batch(out)

    def factors(self, key: int, kinds: dict) -> pa.Table:
        """Contexts and named suffixes of a bucket -> the spans of positions whose previous factors reach the length, by block."""
        found = []
        block, ids, rows, *names, pos = ex.unpack(kinds.get(NAMED, []), *self.named.dtypes)
        _, again = named(ids, pos, *names)
        found.append((block[again], ids[again], rows[again], pos[again].astype(np.int64)))
        if CONTEXTS in kinds:
            t = ex.from_ipc(kinds[CONTEXTS]).combine_chunks()
            block, ids, rows, start, h = (t.column(c).to_numpy() for c in ("block", "id", "row", "start", "h"))
            data = t.column("data").combine_chunks()
            data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
            order = np.argsort(h, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))
            size = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1])
            grown = np.concatenate([[0], np.cumsum(size[order].astype(np.int64))])[edge]
            g = 0
            while g < len(edge) - 1:
                to = max(g + 1, int(np.searchsorted(grown, grown[g] + self.slice_bytes, side="right")) - 1)
                k = order[edge[g] : edge[to]]
                chunk = next(tk.chunks(data.take(pa.array(k)), 1 << 62))
                which = np.repeat(np.arange(len(k), dtype=np.int32), np.diff(chunk.bounds))
                at, rank = prefix_ranks(chunk.data, chunk.bounds[1:][which] - np.arange(len(which)), self.length)
                # A suffix whose prefix no other one has is no repeat.
                on = np.bincount(rank)[rank] > 1
                at, rank = at[on], rank[on]
                far = start[k][which[at]] + at - chunk.bounds[which[at]]
                k = k[which[at]]
                on = repeats(at, rank, _dense(ids[k], far))
                found.append((block[k[on]], ids[k[on]], rows[k[on]], far[on]))
                g = to
        block, ids, rows, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        return ex.rows_to_batch(self.send_spans(block, ids, rows, pos, pos + self.length, key))

    def remove(self, columns: list[str]):
        """Documents and their spans -> the documents with n_bytes, n_removed, n_spans and kept (bytes)."""

        def work(_: int, kinds: dict) -> pa.Table:
            b = ex.Block(kinds[DOCS], self.doc_id, self.text)
            _, _, rows, lo, hi = ex.unpack(kinds.get(SPANS, []), *self.spans.dtypes)
            o = np.argsort(rows, kind="stable")
            rows, lo, hi = rows[o], lo[o].astype(np.int64), hi[o].astype(np.int64)
            counts, kept = ([], [], []), []
            for chunk in tk.chunks(b.texts):
                size = np.diff(chunk.bounds)
                doc, k = b.marks(chunk, rows)
                step = np.zeros(len(chunk.data) + 1, np.int64)
                np.add.at(step, chunk.bounds[doc] + np.minimum(lo[k], size[doc]), 1)
                np.add.at(step, chunk.bounds[doc] + np.minimum(hi[k], size[doc]), -1)
                gone = np.cumsum(step[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                _, _, of = tk.runs(gone, chunk.bounds)
                removed = total[chunk.bounds[1:]] - total[chunk.bounds[:-1]]
                for column, value in zip(counts, (size, removed, tk.counts_by_doc(of, chunk.n)), strict=True):
                    column.append(value)
                kept.append(_slices(chunk.data[~gone], size - removed))
            out = b.table.select(columns)
            for name, value in zip(("n_bytes", "n_removed", "n_spans"), counts, strict=True):
                out = out.append_column(name, pa.array(np.concatenate(value) if value else np.zeros(0, np.int64), pa.int64()))
            return out.append_column("kept", pa.chunked_array(kept, pa.binary()))

        return work


def _slices(data: np.ndarray, size: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])


def dedup_suffixes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, anchor: int = 32, slice_bytes: int = 2 << 20, block_bytes: int = 4 << 20, fan: int | None = None) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, n_spans and kept (the UTF-8 bytes that stay).

    A byte goes if a ``length``-byte string that covers it also starts earlier: in a smaller id,
    or before in the same document. Strings are judged on the input and overlap freely. ``kept``
    is binary, as a repeat may begin inside a character. A null text is empty; an empty table gives
    no row; a very long text is a block of its own. Rows of one id are one document, with one text
    or several; a row with a null id is left whole and compared with nothing. An input column with
    one of the four names is replaced; other names don't matter.
    """
    if not 1 <= anchor < length:
        raise ValueError("an anchor must be shorter than the strings it marks")
    names = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    docs = docs.select(*names).withColumn(doc_id, F.col(doc_id).cast("bigint"))
    n = block_count(docs, text, block_bytes)
    space, d = Workspace(docs.sparkSession, "suffix"), _Dedup(doc_id, text, length, anchor, n, slice_bytes, fan)
    blocks = space.write(ex.blocked(docs, text, block_bytes), "blocks", **LARGE_ROWS)
    met = space.write(ex.exchanged(ex.arrived(ex.each_block(blocks, d.find), d.found, passing=d.spans), n, d.meet), "met", partition_by="kind")
    space.release()
    several = ex.exchanged(d.counts.arrive(met), n, d.add)
    asked = space.write(ex.exchanged(d.first.arrive(met).unionByName(d.several.arrive(several)), n, d.ask), "asked")
    del several
    for kind in (FIRST, COUNTS):
        space.drop(f"met/kind={kind}")
    space.release()
    extracted = space.write(ex.exchanged(blocks.unionByName(d.asked.arrive(asked)), n, d.extract), "extracted", partition_by="kind")
    space.release()
    judged = space.write(ex.exchanged(extracted.where(F.col("kind") == CONTEXTS).unionByName(d.named.arrive(extracted)), n, d.factors), "judged")
    for kind in (CONTEXTS, NAMED):
        space.drop(f"extracted/kind={kind}")
    space.release()
    spans = met.unionByName(extracted).unionByName(judged)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"])
    return ex.exchanged(blocks.unionByName(d.spans.arrive(spans)), n, d.remove(names), schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Suffix-array dedup of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: String by string over the texts in hexadecimal digits; for small tables.
OP4_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), g AS (
  SELECT doc_id, i, CAST(doc_id AS HUGEINT) * 1099511627776 + i AS age, md5_number(substr(hx, 2 * i + 1, 200)) AS h
  FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 99)) AS i FROM d)
), f AS (
  SELECT h, min(age) AS first FROM g GROUP BY h HAVING count(*) > 1
), later AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 100 THEN 0 ELSE 1 END AS fresh FROM g JOIN f USING (h) WHERE age > first WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM later) GROUP BY doc_id, n
), gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spans
  UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(hx, 2 * a + 1) ELSE substr(hx, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
