"""Packed exchanges: few rows that each hold many values, for shuffles of hashes and texts.

A row of the shuffle costs far more than eight bytes, so tasks send one row for each
destination, holding arrays. ``blocked`` writes the documents once, in blocks of some megabytes
that travel as compressed Arrow streams; a document is a row of a block from then on, whatever
its id. Records about documents go to buckets of a hash, and marks go back to the block.

Where there are more destinations than ``FAN``, a sender packs for coarse groups of them and a
second step deals those out, so that rows stay full however many blocks an input has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

_IPC = pa.ipc.IpcWriteOptions(compression="zstd")
#: Rows of an exchange: what the body is, where it goes, a part of the senders, the values.
PACKED = "kind int, key bigint, part int, body binary"
#: Destinations that a sender packs rows for.
FAN = 8192
#: Most partitions of an exchange; a partition may hold several destinations.
MOST_PARTITIONS = 1 << 16
#: Destinations of a partition on average, and partitions for each core that there are before any holds several.
KEYS, PARTITIONS_A_CORE = 4, 3
#: Parts of the senders in the second step of an exchange.
PARTS = 64
DOCS = 0


def split(dest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Indices of each destination that occurs, in order."""
    order = np.argsort(dest, kind="stable")
    d = dest[order]
    cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]])) if len(d) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(d[a]), order[a:b]


def to_ipc(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_IPC) as w:
        w.write(table)
    return sink.getvalue().to_pybytes()


def from_ipc(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def rows_to_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    types = {"kind": pa.int32(), "key": pa.int64(), "part": pa.int32(), "body": pa.binary()}
    return pa.table({name: pa.array(list(c), t) for (name, t), c in zip(types.items(), columns, strict=True)})


# --- blocks of documents -----------------------------------------------------------------------


def blocked(docs: DataFrame, text: str, block_bytes: int) -> DataFrame:
    """The documents in blocks of about ``block_bytes`` of text, each one row: kind 0, key (the block), body."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, n = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            room = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).cumsum() if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                done = room[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(room, done + block_bytes - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(room[to - 1] - done)
                at = to
                if size >= block_bytes or at < batch.num_rows:
                    yield from rows_to_batch([(DOCS, (task << 24) + n, n % PARTS, to_ipc(pa.Table.from_batches(held).combine_chunks()))]).to_batches()
                    held, size, n = [], 0, n + 1
        if held:
            yield from rows_to_batch([(DOCS, (task << 24) + n, n % PARTS, to_ipc(pa.Table.from_batches(held).combine_chunks()))]).to_batches()

    return docs.mapInArrow(run, PACKED)


class Block:
    """A block of documents: its table, ids, and for each row the row that stands for it.

    Rows with one id and one text share a representative; only representatives are compared, and
    marks on one hold for all. Rows with a null id stand for themselves and are compared with nothing.
    """

    def __init__(self, bodies: list[bytes], doc_id: str, text: str):
        self.table = from_ipc(bodies).combine_chunks()
        ids = self.table.column(doc_id)
        self.texts = self.table.column(text)
        self.known = ids.is_valid().to_numpy()
        self.ids = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
        self.rep = np.arange(len(self.ids))
        order = np.argsort(self.ids[self.known], kind="stable")
        order = np.flatnonzero(self.known)[order]
        again = np.flatnonzero(self.ids[order][1:] == self.ids[order][:-1])
        seen: dict[tuple, int] = {}
        for i in np.unique(np.concatenate([order[again], order[again + 1]])) if len(again) else []:
            self.rep[i] = seen.setdefault((int(self.ids[i]), self.texts[int(i)].as_py()), int(i))

    @property
    def usable(self) -> np.ndarray:
        """Which rows are compared."""
        return self.known & (self.rep == np.arange(len(self.rep)))

    def marks(self, chunk: tk.Chunk, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For marks sorted by ``row``: the documents of a chunk and the marks that apply to them, as pairs."""
        stands = self.rep[chunk.first : chunk.first + chunk.n]
        a, b = np.searchsorted(row, stands, "left"), np.searchsorted(row, stands, "right")
        n = b - a
        doc = np.repeat(np.arange(chunk.n), n)
        return doc, np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())


# --- records -----------------------------------------------------------------------------------


def pack(block: np.ndarray, ids: np.ndarray, rows: np.ndarray, *columns: np.ndarray) -> bytes:
    """Records in runs of one document (block and row): steps of blocks and ids, rows, run lengths, then each column."""
    n = len(rows)
    cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (block[1:] != block[:-1])])) if n else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([cut, [n]]))
    steps = [np.diff(x[cut].astype(np.int64), prepend=np.int64(0)) for x in (block, ids)]
    parts = [*steps, rows[cut].astype(np.uint32), runs.astype(np.uint32), *columns]
    return np.array([len(cut), n], np.int64).tobytes() + b"".join(tk.packed(p) for p in parts)


def _unpack(blob: bytes, *dtypes) -> tuple[np.ndarray, ...]:
    runs, n = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at, out = 16, []
    for size, dtype in ((runs, np.int64), (runs, np.int64), (runs, np.uint32), (runs, np.uint32), *((n, d) for d in dtypes)):
        to = at + size * np.dtype(dtype).itemsize
        out.append(tk.unpacked(blob[at:to], dtype) if size else np.empty(0, dtype))
        at = to
    times = out[3]
    return np.repeat(np.cumsum(out[0]), times), np.repeat(np.cumsum(out[1]), times), np.repeat(out[2].astype(np.int64), times), *out[4:]


def unpack(blobs: list[bytes], *dtypes) -> tuple[np.ndarray, ...]:
    """Blocks, ids, rows and columns of the records in some bodies."""
    if not blobs:
        return *(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, d) for d in dtypes)
    return tuple(np.concatenate(x) for x in zip(*(_unpack(b, *dtypes) for b in blobs), strict=True))


class Route:
    """How records of one kind travel: their column types, and how many destinations there are."""

    def __init__(self, kind: int, parts: int, *dtypes, fan: int | None = None):
        self.kind, self.dtypes, self.fan = kind, dtypes, fan or FAN
        self.coarse = parts > self.fan

    def _group(self, dest: np.ndarray) -> np.ndarray:
        return (tk.mix(dest.astype(np.int64).view(np.uint64)) % tk.U64(self.fan)).astype(np.int64)

    def send(self, dest: np.ndarray, block: np.ndarray, ids: np.ndarray, rows: np.ndarray, *columns: np.ndarray, part: int = 0) -> list[tuple[int, int, int, bytes]]:
        """Rows of an exchange; records of one document should lie together."""
        if self.coarse:
            return [(self.kind, g, part % PARTS, pack(block[k], ids[k], rows[k], dest[k].astype(np.int64), *(c[k] for c in columns))) for g, k in split(self._group(dest))]
        return [(self.kind, p, part % PARTS, pack(block[k], ids[k], rows[k], *(c[k] for c in columns))) for p, k in split(dest)]

    def arrive(self, rows: DataFrame) -> DataFrame:
        """The rows of this kind by their last destination."""
        rows = rows.where(F.col("kind") == self.kind)
        if not self.coarse:
            return rows

        def run(key: tuple, table: pa.Table) -> pa.Table:
            block, ids, row, dest, *columns = unpack(table.column("body").to_pylist(), np.int64, *self.dtypes)
            return rows_to_batch([(self.kind, p, int(key[1].as_py()), pack(block[k], ids[k], row[k], *(c[k] for c in columns))) for p, k in split(dest)])

        return rows.groupBy("key", "part").applyInArrow(run, PACKED)


def arrived(rows: DataFrame, *routes: Route, passing: Route | None = None) -> DataFrame:
    """The rows of several kinds by their last destination; rows of ``passing`` keep their key. Where one
    step does, ``rows`` is read once."""
    if not any(r.coarse for r in routes):
        return rows.where(F.col("kind").isin(*[r.kind for r in routes], *([passing.kind] if passing else [])))
    parts = [r.arrive(rows) for r in routes]
    return reduce(DataFrame.unionByName, [*parts, rows.where(F.col("kind") == passing.kind)] if passing else parts)


def partitions(keys: int, cores: int) -> int:
    """Partitions of an exchange to so many keys. A task takes its keys one by one, so several of them need no
    more memory, and each task that there is not is a file less of each kind that the exchange writes."""
    return min(max(min(keys, PARTITIONS_A_CORE * cores), -(-keys // KEYS)), MOST_PARTITIONS)


def exchanged(rows: DataFrame, parts: int, work: Callable[[int, dict[int, list[bytes]]], pa.Table], schema: str = PACKED) -> DataFrame:
    """Bring the rows of each of about ``parts`` keys together and run ``work`` on them: key, {kind: bodies}.
    The number of partitions follows that of the keys, whatever the shuffle parallelism, so that a task stays short."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds: dict[int, list[bytes]] = {}
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist(), strict=True):
            kinds.setdefault(kind, []).append(body)
        return work(int(key[0].as_py()), kinds)

    n = partitions(parts, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, "key").groupBy("key").applyInArrow(run, schema)


def each_block(blocks: DataFrame, work: Callable[[int, list[bytes]], pa.Table]) -> DataFrame:
    """Run ``work`` on every block as it lies in its table, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, body in zip(b.column(1).to_pylist(), b.column(3), strict=True):
                yield from work(key, [body.as_py()]).combine_chunks().to_batches()

    return blocks.mapInArrow(run, PACKED)


def sha256_column(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)
