"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which tokens overlap.

Documents are cut into blocks of some megabytes. Texts fall into segments at single spaces before a
visible character, where both tokenizers always end a token: the pattern of the byte-level one starts
a word there, and no piece of the other has a space behind another character (a vocabulary that has
one gets whole texts as segments). A block encodes each distinct segment once, lays the tokens of
both sides end to end as interval tables on one byte axis, and DuckDB, in the task, does the
alignment by joins and windows over them:

* overlaps: a token's range begins inside exactly one token of the other side, so ASOF joins in both
  directions give every overlapping pair once, at the place where the later of the two begins;
* groups: a range that begins on both sides at once begins a group, and a window sum of those
  beginnings numbers the groups of each side.

Of each block its distinct id pairs with the number of documents that hold them go to Spark, which
merges these partial counts over the corpus and sends each block the counts of its pairs back. The
best count of an A id is a table no longer than the vocabulary. Documents never travel: a block is
written once, packed, and meets its counts by the block's number.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .exchange import from_ipc, to_ipc
from .tokens import PATTERN
from .workspace import Workspace

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: A pair's two ids in one integer; ids of both vocabularies are below 2 ** PAIR_BITS.
PAIR_BITS = 16
#: A run of white space from which the pattern matcher of the fast encoder would run out of stack.
LONG_BLANK = re.compile(r"\s{20000}")
_PARTS = "block bigint, pair bigint, docs bigint, body binary"
_DOCUMENTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_loaded: dict[int, object] = {}


def _byte_level() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
    others for code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _laid(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The bytes of a vocabulary's tokens, and their number for each."""
    return pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], np.int64)


class ByteBpe:
    """Side A: a byte-level BPE vocabulary in JSON. Strings of special tokens are ordinary text."""

    def __init__(self, raw: bytes):
        import tiktoken

        self.raw, self.whole = raw, None
        of = _byte_level()
        ranks = {bytes(of[c] for c in token): i for token, i in json.loads(raw)["model"]["vocab"].items()}
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.table, self.sizes, self.shown = *_laid(self.bytes), None

    def _slowly(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.raw.decode())
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        return [self._slowly(t) if len(t) >= 20000 and LONG_BLANK.search(t) else self.encoding.encode_ordinary(t) for t in texts]


class PieceBpe:
    """Side B: a sentencepiece model, which puts the space in front itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        name = self.model.id_to_piece
        self.bytes = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]
        self.table, self.sizes = _laid(self.bytes)
        #: Whether a token always ends before a space behind another character.
        self.splits = not any(b" " in token.lstrip(b" ") for token in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        return self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []


def _vocabulary(kind: type, raw: bytes):
    key = hash((kind.__name__, raw))
    if key not in _loaded:
        _loaded[key] = kind(raw)
    return _loaded[key]


#: Bytes that begin a visible character; lead bytes of characters among which are blanks are left out.
_VISIBLE = np.array([0x21 <= b <= 0x7E or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) for b in range(256)])
_TABLES = tk.byte_table(71), tk.byte_table(72)


class Segments:
    """The segments of a chunk's texts, each with the space in front: the document of each, and the distinct ones."""

    def __init__(self, chunk: tk.Chunk, cut: bool):
        data = np.insert(chunk.data, chunk.bounds[:-1], 32)
        bounds = chunk.bounds + np.arange(chunk.n + 1)
        begins = np.zeros(len(data), bool)
        if cut and len(data) > 2:
            space = data == 32
            begins[1:-1] = space[1:-1] & ~space[:-2] & _VISIBLE[data[2:]]
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(bounds, starts, side="right") - 1
        some = np.diff(bounds)[doc] > 1  # an empty text has no segment
        starts, ends, self.doc = starts[some], ends[some], doc[some]
        one, other = (tk.span_hash(tk.prefix(t[data]), starts, ends) for t in _TABLES)
        _, first, self.of = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(other[first][self.of], other):  # two segments of one hash
            first = self.of = np.arange(len(starts))
        self.texts = [data[a:b].tobytes() for a, b in zip(starts[first], ends[first], strict=True)]


class Side:
    """The tokens of one side, laid end to end: ids, numbers of tokens of each segment, ends in bytes."""

    def __init__(self, vocabulary, texts: list[str]):
        found = vocabulary.encode(texts)
        self.count = np.array([len(x) for x in found], np.int64)
        self.ids = np.fromiter(chain.from_iterable(found), np.int32, int(self.count.sum()))
        self.vocabulary = vocabulary
        self.ends = np.cumsum(vocabulary.sizes[self.ids])

    def differ(self, texts: list[bytes]) -> np.ndarray:
        """Segments whose tokens' bytes aren't their own."""
        data = self.vocabulary.table.take(pa.array(self.ids)).buffers()[2] if len(self.ids) else None
        got, at = data.to_pybytes() if data else b"", np.concatenate([[0], self.ends])[np.concatenate([[0], np.cumsum(self.count)])]
        return np.array([got[x:y] != t for x, y, t in zip(at[:-1], at[1:], texts, strict=True)], bool)

    def without(self, bad: np.ndarray) -> None:
        """Drop the tokens of some segments."""
        stay = np.repeat(~bad, self.count)
        self.ids, self.count = self.ids[stay], np.where(bad, 0, self.count)
        self.ends = np.cumsum(self.vocabulary.sizes[self.ids])

    def intervals(self) -> pa.Table:
        """i, s (start), id of every token; starts ascend."""
        return pa.table({"i": np.arange(len(self.ids)), "s": self.ends - self.vocabulary.sizes[self.ids], "id": self.ids})


#: Every A token with the B token in which it begins, and the group it is in.
_OF_A = """
WITH l AS (SELECT a.i, a.id AS a, b.id AS b, CAST(a.s = b.s AS INTEGER) AS begins FROM a ASOF JOIN b ON a.s >= b.s)
SELECT a, b, CAST(sum(begins) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM l ORDER BY i
"""
#: The same for B; a B token that begins where an A token does is in the rows of A already.
_OF_B = """
WITH l AS (SELECT b.i, a.id AS a, b.id AS b, CAST(a.s = b.s AS INTEGER) AS begins FROM b ASOF JOIN a ON b.s >= a.s)
SELECT a, b, begins = 0 AS inside, CAST(sum(begins) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS g FROM l ORDER BY i
"""
_SEPARATORS = (b",", b"|", b";")


def _rendered(a: Side, b: Side, ga: np.ndarray, gb: np.ndarray) -> pa.Array:
    """The groups of each segment, ``a1,a2|b1;a3|b2,b3;``."""
    order_a, order_b = np.arange(len(ga)) + np.searchsorted(gb, ga, "left"), np.arange(len(gb)) + np.searchsorted(ga, gb, "right")
    code = np.empty(len(ga) + len(gb), np.int64)
    last = lambda g: np.concatenate([g[1:] != g[:-1], [True]])[: len(g)].astype(np.int64)
    code[order_a] = len(_SEPARATORS) * a.ids + last(ga)
    code[order_b] = len(_SEPARATORS) * b.ids + 2 * last(gb)
    known = a.vocabulary
    if known.shown is None:
        most = max(len(a.vocabulary.bytes), len(b.vocabulary.bytes))
        known.shown = pa.array([str(i).encode() + s for i in range(most) for s in _SEPARATORS], pa.large_binary())
    tokens = known.shown.take(pa.array(code))
    off = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
    bounds = np.concatenate([[0], np.cumsum(a.count + b.count)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a.count), [None, pa.py_buffer(off[bounds].tobytes()), tokens.buffers()[2]])


class Aligned:
    """The alignment of a chunk of texts: for each text its counts and its groups; links as (text, pair)."""

    def __init__(self, raw_a: bytes, raw_b: bytes, chunk: tk.Chunk):
        import duckdb

        known_a, known_b = _vocabulary(ByteBpe, raw_a), _vocabulary(PieceBpe, raw_b)
        segments = Segments(chunk, known_b.splits)
        texts = [t.decode() for t in segments.texts]
        a, b = Side(known_a, texts), Side(known_b, texts)
        bad = a.differ(segments.texts) | b.differ(segments.texts)
        for side in (a, b):
            side.without(bad)
        n = len(texts)
        if len(a.ids):
            with duckdb.connect(config={"threads": 1}) as con:
                con.register("a", a.intervals())
                con.register("b", b.intervals())
                of_a, of_b = (con.sql(q).to_arrow_table() for q in (_OF_A, _OF_B))
            number = lambda t, c: t.column(c).to_numpy().astype(np.int64)
            inside = of_b.column("inside").to_numpy().astype(bool)
            ga, gb = number(of_a, "g"), number(of_b, "g")
            pair = lambda t: number(t, "a") << PAIR_BITS | number(t, "b")
            of_a_token, of_b_token = (np.repeat(np.arange(n), s.count) for s in (a, b))
            owner = np.concatenate([of_a_token, of_b_token[inside]])
            order = np.argsort(owner, kind="stable")
            self._pairs = np.concatenate([pair(of_a), pair(of_b)[inside]])[order]
            begins = np.concatenate([[True], ga[1:] != ga[:-1]])
            n_links, n_groups = np.bincount(owner, minlength=n), np.bincount(of_a_token[begins], minlength=n)
        else:
            ga = gb = self._pairs = np.zeros(0, np.int64)
            n_links = n_groups = np.zeros(n, np.int64)
        dropped = np.zeros(chunk.n, bool)
        dropped[segments.doc[bad[segments.of]]] = True  # of a text with one bad segment nothing stays
        stays = ~dropped[segments.doc]
        self._doc, self._of = segments.doc[stays], segments.of[stays]
        total = lambda of: np.bincount(self._doc, of[self._of], minlength=chunk.n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = total(a.count), total(b.count), total(n_groups), total(n_links)
        self._n, self._links, self._shown = chunk.n, n_links, _rendered(a, b, ga, gb)

    def groups(self) -> Iterator[memoryview]:
        """For each text its groups, ``a1,a2|b1;a3|b2,b3``."""
        shown = self._shown.take(pa.array(self._of)) if len(self._of) else None
        off = np.frombuffer(shown.buffers()[1], np.int64)[: len(shown) + 1] if shown else np.zeros(1, np.int64)
        data = memoryview(shown.buffers()[2]) if shown else memoryview(b"")
        at = off[np.searchsorted(self._doc, np.arange(self._n + 1))]
        for x, y in zip(at[:-1], at[1:], strict=True):
            yield data[x : max(x, y - 1)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair and number of each distinct pair of a text."""
        size, begins = self._links[self._of], (np.cumsum(self._links) - self._links)[self._of]
        at = np.repeat(begins - np.cumsum(size) + size, size) + np.arange(size.sum())
        key = np.sort(np.repeat(self._doc, size) << (2 * PAIR_BITS) | self._pairs[at])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key[first] >> (2 * PAIR_BITS), key[first] & ((1 << 2 * PAIR_BITS) - 1), np.diff(np.concatenate([first, [len(key)]]))


def _aligned(shared, block_bytes: int):
    """(doc_id, text) -> a row for each distinct pair of a block, and one with the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_a, raw_b = shared.value
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for chunk in tk.chunks(batch.column(1), block_bytes):
                rows = batch.slice(chunk.first, chunk.n)
                block = (task << 24) + n
                n += 1
                found = Aligned(raw_a, raw_b, chunk)
                text, pair, times = found.links()
                pairs, place = np.unique(pair, return_inverse=True)
                digest = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in found.groups()]
                docs = pa.table({"doc_id": rows.column(0), "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "n_links": found.n_links, "groups_sha256": digest})
                bounds = np.searchsorted(text, np.arange(chunk.n + 1))
                body = pa.table({"docs": [to_ipc(docs)], "bounds": [bounds.tobytes()], "pairs": [tk.packed(pairs)], "place": [tk.packed(place.astype(np.uint32))], "times": [tk.packed(times.astype(np.uint32))]})
                none = np.zeros(len(pairs) + 1, bool)
                none[-1] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pairs) + 1, block)),
                        pa.array(np.concatenate([pairs, [0]]), pa.int64(), mask=none),
                        pa.array(np.concatenate([np.bincount(place, minlength=len(pairs)), [0]]), pa.int64(), mask=none),
                        pa.array([*[None] * len(pairs), to_ipc(body)], pa.binary()),
                    ],
                    ["block", "pair", "docs", "body"],
                )

    return run


def _summed(key: tuple, block: pa.Table, counts: pa.Table) -> pa.Table:
    """A block and the counts of its pairs -> its documents."""
    out = []
    for row in from_ipc(block.column("body").to_pylist()).to_pylist():
        docs, bounds = from_ipc([row["docs"]]), np.frombuffer(row["bounds"], np.int64)
        pairs = tk.unpacked(row["pairs"], np.int64) if row["pairs"] else np.zeros(0, np.int64)
        place, times = (tk.unpacked(row[c], np.uint32).astype(np.int64) if row[c] else np.zeros(0, np.int64) for c in ("place", "times"))
        total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.searchsorted(pairs, counts.column("pair").to_numpy())
        total[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[place] * times)])[bounds]) for v in (best, total)]
        for name, s in zip(("n_best", "count_sum"), sums, strict=True):
            docs = docs.append_column(name, pa.array(s))
        out.append(docs.select([f.split()[0] for f in _DOCUMENTS.split(", ")]))
    return pa.concat_tables(out)


class Alignment:
    """The alignment of all texts of ``docs`` under two vocabularies.

    A text that is null, empty, or whose tokens on one side aren't the bytes of the text with a space
    before it has no tokens: zeros and an empty digest. Each row is a document of its own, whether or not
    ids repeat or are null. An empty table gives no row; a very long text is one block, so that it costs
    a task memory in proportion to it. Only id and text are read, so other columns of any name don't matter.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, block_bytes: int = 4_000_000):
        self.spark = docs.sparkSession
        raw = []
        for path in (byte_bpe, piece_bpe):  # some megabytes each
            with open(path, "rb") as f:
                raw.append(f.read())
        self._shared = self.spark.sparkContext.broadcast(tuple(raw))
        self._rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        self._space = Workspace(self.spark, "alignment")
        self._parts = self._space.write(self._rows.mapInArrow(_aligned(self._shared, block_bytes), _PARTS), "parts")
        self._asked = self._parts.where(F.col("pair").isNotNull()).select("block", "pair", "docs")
        self._counts: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """pair (A id and B id in one integer), a_id, b_id, n (documents that hold the pair linked), best (1 if
        no pair of its A id has more)."""
        if self._counts is None:
            self._counts = self._space.write(self._asked.groupBy("pair").agg(F.sum("docs").alias("n")), "counts")
        a_id = F.shiftright("pair", PAIR_BITS)
        # No more rows than side A's vocabulary has ids.
        most = self._counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
        known = self._counts.withColumn("a_id", a_id).join(F.broadcast(most), "a_id")
        return known.select("pair", "a_id", F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1).alias("b_id"), "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
        counts = self._asked.select(F.col("block").alias("of"), "pair").join(self.pairs().select("pair", "n", "best"), "pair")
        blocks = self._parts.where(F.col("body").isNotNull()).select("block", "body")
        return blocks.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_summed, _DOCUMENTS)

    def groups(self) -> DataFrame:
        """doc_id, groups: the groups of every row as text, encoded anew."""
        shared = self._shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in tk.chunks(batch.column(1)):
                    found = Aligned(*shared.value, chunk)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n), pa.array([bytes(g).decode() for g in found.groups()], pa.string())], ["doc_id", "groups"])

        return self._rows.mapInArrow(run, "doc_id bigint, groups string")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Byte-level BPE against pieces, on all documents."""
    return Alignment(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()
