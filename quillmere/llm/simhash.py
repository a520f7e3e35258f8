"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four
bits differ in at most one bit of some segment, so they agree on one of that segment's
one-wildcard variants (the segment with one bit deleted). Variants are equality-joined and
every candidate is verified on all 64 bits.

Exact copies share a fingerprint and are one node. A bucket of equal variants never emits its
pairs: it walks the verified links breadth first and emits one row for each member, to the
smallest fingerprint it reaches, so output is linear in the members of a bucket. Components
are then closed over those rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import textkit as tk
from .components import components
from .workspace import Workspace, aside

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of so few segments that one of them differs by at most one of ``bits`` bits."""
    n = bits // 2 + 1
    if not 1 <= n <= 16:
        raise ValueError("segments of at least four bits allow up to 31 differing bits")
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def variants(bits: int) -> list[tuple[int, int, int]]:
    """Every segment with each of its bits as the wildcard."""
    return [(low, width, bit) for low, width in segments(bits) for bit in range(width)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotl(acc + word * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many spans of one byte array at once."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    w8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    w4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    size = ends - starts
    h = np.full(len(starts), np.uint64(seed) + P5)
    big = np.flatnonzero(size >= 32)
    if len(big):
        v = [np.full(len(big), np.uint64(x % 2**64)) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
        stripes = size[big] // 32
        for j in range(int(stripes.max())):
            on = np.flatnonzero(stripes > j)
            at = starts[big[on]] + 32 * j
            for lane in range(4):
                v[lane][on] = _lane(v[lane][on], w8[at + 8 * lane])
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for lane in range(4):
            x = (x ^ _lane(np.zeros(len(big), np.uint64), v[lane])) * P1 + P4
        h[big] = x
    h += size.astype(np.uint64)
    at, left = starts + 32 * (size // 32), size % 32
    for j in range(3):
        on = np.flatnonzero(left >= 8 * (j + 1))
        h[on] = _rotl(h[on] ^ _lane(np.zeros(len(on), np.uint64), w8[at[on] + 8 * j]), 27) * P1 + P4
    at, left = at + 8 * (left // 8), left % 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rotl(h[on] ^ (w4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at, left = at + 4 * (left // 4), left % 4
    for j in range(3):
        on = np.flatnonzero(left > j)
        h[on] = _rotl(h[on] ^ (padded[at[on] + j].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def fingerprints(chunk: tk.Chunk, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of every document of a chunk, as uint64."""
    starts, ends, doc = chunk.words()
    out = np.zeros(chunk.n, np.uint64)
    if not len(starts):
        return out
    # The words of each document joined by one space, A-Z lowered.
    blank = tk.WHITESPACE[chunk.data]
    keep = ~blank
    after = np.zeros(len(blank), bool)
    after[ends[ends < len(blank)]] = True
    keep |= blank & after
    flat = tk.LOWER[chunk.data]
    flat[blank] = 32
    flat = flat[keep]
    place = np.cumsum(keep) - 1
    s, e = place[starts], place[ends - 1] + 1
    n = tk.counts_by_doc(doc, chunk.n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    m = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    owner = np.repeat(np.arange(chunk.n), m)
    begin = np.concatenate([[0], np.cumsum(m)])[:-1]
    word = np.arange(m.sum()) - begin[owner] + first[owner]
    last = np.minimum(word + shingle - 1, first[owner] + n[owner] - 1)
    h = xxh64(flat, s[word], e[last], seed)
    some = np.flatnonzero(m)
    # Documents are summed in slabs so that the unpacked bits stay small.
    slab = 1 << 16
    counts = np.zeros((chunk.n, 64), np.int64)
    for at in range(0, len(h), slab):
        part = h[at : at + slab]
        own = owner[at : at + slab]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    bits = (2 * counts[some] > m[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp, the fingerprint as a signed 64-bit integer."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprints(c) for c in tk.chunks(b.column(b.num_columns - 1), 1 << 20)]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _variant_value(fp: np.ndarray, variant: tuple[int, int, int]) -> np.ndarray:
    low, width, bit = variant
    mask = ((1 << width) - 1) & ~(1 << bit)
    return (fp >> np.uint64(low)) & np.uint64(mask)


def _emit_variants(parts: int, bits: int, held_fps: int = 1 << 21):
    """Fingerprints -> packed arrays by bucket; a task sends a bucket one row for each ``held_fps`` it reads."""

    def packed(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for v, variant in enumerate(variants(bits)):
            part = (tk.mix(_variant_value(fp, variant)) % np.uint64(parts)).astype(np.int64)
            rows = [(v * parts + p, fp[at].tobytes()) for p, at in ex.split(part)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "fps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            size += b.num_rows
            if size >= held_fps:
                yield from packed(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from packed(np.concatenate(held))

    return run


def _walk(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth first over links within ``fp`` (sorted): members and the smallest one they reach."""
    rest, members, roots = fp, [], []
    while len(rest) > 1:
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                members.append(found)
                roots.append(np.full(len(found), root))
                queue.extend(found)
    if not members:
        return fp[:0], fp[:0]
    return np.concatenate(members), np.concatenate(roots)


def _merged(members: list[np.ndarray], roots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row for each member of the joined links: the smallest fingerprint they lead to."""
    u, v = np.concatenate(members), np.concatenate(roots)
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def _within(fp: np.ndarray, segment: tuple[int, int], bits: int, small: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket. A large bucket is split once more: its members differ in at most
    ``bits`` of the bits outside the segment, so of bits // 2 + 1 pieces of those one differs by at
    most one bit, and one-wildcard variants of the pieces make smaller buckets."""
    if len(fp) <= small:
        return _walk(fp, bits)
    low, width = segment
    free = [i for i in range(64) if not low <= i < low + width]
    members, roots = [], []
    for piece in np.array_split(free, bits // 2 + 1):
        for wild in piece:
            mask = np.uint64(sum(1 << int(i) for i in piece if i != wild))
            value = fp & mask
            order = np.argsort(value, kind="stable")
            f, x = fp[order], value[order]
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            for i in np.flatnonzero(np.diff(edge) > 1):
                m, r = _walk(np.sort(f[edge[i] : edge[i + 1]]), bits)
                members.append(m)
                roots.append(r)
    return _merged(members, roots) if members else (fp[:0], fp[:0])


def _link(parts: int, bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        variant = variants(bits)[int(key[0].as_py()) // parts]
        fp = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("fps").to_pylist()]))
        value = _variant_value(fp, variant)
        order = np.argsort(value, kind="stable")
        fp, value = fp[order], value[order]
        edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        size = np.diff(edge)
        members, roots = [], []
        # Two by two where a bucket holds two; the walk for larger ones.
        two = edge[:-1][size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
        members.append(np.maximum(fp[near], fp[near + 1]))
        roots.append(np.minimum(fp[near], fp[near + 1]))
        for i in np.flatnonzero(size > 2):
            m, r = _within(fp[edge[i] : edge[i + 1]], variant[:2], bits)
            members.append(m)
            roots.append(r)
        return pa.table({"u": np.concatenate(members).view(np.int64), "v": np.concatenate(roots).view(np.int64)})

    return run


def links(nodes: DataFrame, bits: int = 4, per_part: int = 1_000_000) -> DataFrame:
    """u, v: fingerprints of ``nodes`` (distinct, column fp) in one component of a bucket's links."""
    parts = max(1, -(-nodes.count() // per_part))
    emitted = nodes.select("fp").mapInArrow(_emit_variants(parts, bits), "bucket bigint, fps binary")
    return emitted.groupBy("bucket").applyInArrow(_link(parts, bits), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4, salts: int = 64) -> DataFrame:
    """doc_id, fp, component_id for every row; component_id is the smallest id of the component.

    A null text, or one without words, has fingerprint zero and is linked like any other; a very
    long text is one fingerprint and costs memory in proportion to it. Rows of one id are one
    document; a null id names no component (a component of null ids only has a null id). An empty
    table gives no row. Only id and text are read, so other columns of any name don't matter.

    A component or a fingerprint may hold a third of all rows: names of large components and of frequent
    fingerprints (over a thousandth of the fingerprints or rows, so at most a thousand of each) go back to
    their members in ``salts`` copies.
    """
    space = Workspace(docs.sparkSession, "simhash")
    prints = space.write(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "prints")
    nodes = space.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes, bits), space)
    hung = nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"]).select("fp", "first", "root")
    # Smallest ids are combined in the task before they meet by component. Names of components of over a thousandth
    # of the fingerprints, of which there are under a thousand, go out in copies.
    many = F.lit(nodes.count())
    least = space.write(hung.groupBy("root").agg(F.min("first").alias("least"), (F.count(F.lit(1)) * 1000 > many).alias("hub")), "least")
    rooted = nodes.join(least.hint("merge"), nodes["fp"] == least["root"]).select(F.col("fp").alias("root"), F.least("first", "least").alias("component_id"), "hub")
    copies = rooted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hub"), salts - 1).otherwise(0))))
    hubs = F.broadcast(least.where("hub").select(F.col("root").alias("__hub")))
    spread = F.when(F.col("__hub").isNotNull(), F.pmod(F.xxhash64("fp"), F.lit(salts))).otherwise(0).cast("int")
    members = hung.join(hubs, F.col("root") == F.col("__hub"), "left").withColumn("salt", spread).join(copies.hint("merge"), ["root", "salt"]).select("fp", "component_id")
    rooted = rooted.select("root", "component_id")
    linked = members.unionAll(rooted).withColumnRenamed("fp", "__fp")
    named = nodes.join(linked.hint("merge"), nodes["fp"] == linked["__fp"], "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n")
    frequent = F.col("n") * 1000 > F.lit(prints.count())
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(frequent, salts - 1).otherwise(0)))).select(F.col("fp").alias("__fp"), "salt", "component_id")
    hot = F.broadcast(nodes.where(frequent).select(F.col("fp").alias("__hot")))
    salted = prints.join(hot, F.col("fp") == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"))
    return salted.join(spread.hint("merge"), (F.col("fp") == F.col("__fp")) & (F.col("__salt") == F.col("salt"))).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, and of the rows that repeat it one.

    Which of several rows of an id stays is decided by their texts, then by all other columns. Rows
    with a null id can't be told apart by it and stay. All columns are kept.
    """
    docs, own = aside(docs, doc_id, text)
    found = near_duplicates(docs, doc_id, text, bits).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    goes = found.where(~F.col("stays")).select(F.col("doc_id").alias("__gone"))
    left = docs.join(goes, F.col(doc_id) == F.col("__gone"), "left_anti")
    repeated = found.where("stays and n > 1").select(F.col("doc_id").alias("__again"))
    once = left.join(repeated, F.col(doc_id) == F.col("__again"), "left_anti")
    # Of a repeated id one row, by an aggregate that combines in the task.
    row = F.struct(F.xxhash64(text).alias("__hash"), *[F.col(c) for c in docs.columns])
    several = left.join(repeated, F.col(doc_id) == F.col("__again"), "left_semi").groupBy(F.col(doc_id).alias("__id")).agg(F.min(row).alias("__row"))
    both = once.unionByName(several.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
    return both.select(*[F.col(n).alias(c) for c, n in own.items()])


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
