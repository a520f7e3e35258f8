"""Vectorised text primitives on Arrow string buffers: words, rolling hashes, window minima.

Every function works on a *chunk*: the UTF-8 bytes of several whole documents laid end to
end with their offsets. Hashes are polynomials modulo 2**64 over a random byte table, so
the hash of any substring is a difference of two prefix sums times an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RADIX = int("9E3779B97F4A7C15", 16)
_MIX = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the radix and of its inverse modulo 2**64."""
    if not _powers or len(_powers["p"]) < n:
        size = 1 << max(16, int(n).bit_length())
        for key, base in (("p", _RADIX), ("i", pow(_RADIX, -1, 2**64))):
            steps = np.full(size, U64(base))
            steps[0] = U64(1)
            _powers[key] = np.cumprod(steps, dtype=U64)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a 64-bit value over all bits."""
    h = h ^ (h >> U64(32))
    h = h * _MIX
    h ^= h >> U64(32)
    h *= _MIX
    h ^= h >> U64(32)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * radix**i, one longer than values."""
    p, _ = powers(len(values) + 1)
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each [start, end) from the prefix sums."""
    _, inv = powers(len(pre))
    return mix((pre[ends] - pre[starts]) * inv[starts])


def rolling(pre: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k values."""
    n = len(pre) - k
    if n <= 0:
        return np.empty(0, U64)
    _, inv = powers(len(pre))
    return mix((pre[k:] - pre[:n]) * inv[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, in time independent of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.concatenate([x, np.full((-len(x)) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


class Chunk:
    """Whole documents: ``data`` their bytes, document i is data[bounds[i]:bounds[i+1]]."""

    __slots__ = ("data", "bounds", "first")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the maximal runs of non-white-space bytes."""
        return runs(~WHITESPACE[self.data], self.bounds)


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the runs of True; a run never crosses a bound."""
    n = len(mask)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:n]
    finishes = mask.copy()
    finishes[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(bounds, starts, side="right") - 1


def chunks(texts: pa.Array, max_bytes: int = 1 << 21, max_docs: int = 1 << 20) -> Iterator[Chunk]:
    """Cut an Arrow string column to chunks of about max_bytes; a longer document is one chunk."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if len(texts) == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        to = min(to, len(texts), at + max_docs)
        yield Chunk(whole[off[at] : off[to]], off[at : to + 1] - off[at], at)
        at = to


def word_sequence(chunk: Chunk, table: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with starts, ends and documents; ``data`` may replace the bytes that are hashed."""
    starts, ends, docs = chunk.words()
    pre = prefix(table[chunk.data if data is None else data])
    return span_hash(pre, starts, ends), starts, ends, docs


def counts_by_doc(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Bytes of an integer array, transposed so that equal high bytes lie together."""
    a = np.ascontiguousarray(values)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def unpacked(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()
