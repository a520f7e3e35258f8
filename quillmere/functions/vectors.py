"""Vector arithmetic on array columns, and hash embeddings."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def invalid_reason(v: Column, dimension: int) -> Column:
    """Null for a usable vector, else why it is refused."""
    return (
        F.when(v.isNull(), "missing")
        .when(F.size(v) != dimension, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(~F.exists(v, lambda x: x != 0), "zero")
    )


def literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))), F.lit("]"))


def parse_literal(c: Column) -> Column:
    return F.transform(F.split(F.btrim(c, F.lit("[] ")), ","), lambda x: F.trim(x).cast("double"))


def hash_embedding(dimension: int = 1024, instruction: str = ""):
    """An Arrow UDF: text -> unit vector of hashed terms. ASCII words weigh 2; CJK runs give 1-, 2-
    and 3-grams of weights 0.25, 1.5 and 2.5. The slot is the first 8 bytes of SHA-256. A query's
    embedding may have an instruction before the text. Slots of terms are kept over batches, and a
    slab of rows is summed at once."""
    weights = {1: 0.25, 2: 1.5, 3: 2.5}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots: dict[str, int] = {}

        def slot(term: str) -> int:
            if term not in slots:
                if len(slots) > 1 << 20:
                    slots.clear()
                slots[term] = int.from_bytes(hashlib.sha256(term.encode()).digest()[:8], "big") % dimension
            return slots[term]

        for batch in batches:
            out: list[np.ndarray] = []
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                place, weight = [], []
                for i, text in enumerate(part):
                    folded = unicodedata.normalize("NFKC", instruction + (text or "")).casefold()
                    terms = [("word:" + w, 2.0) for w in re.findall(r"[a-z0-9]+", folded)]
                    for run in re.findall(r"[㐀-鿿]+", folded):
                        terms += [(f"cjk{n}:" + run[j : j + n], w) for n, w in weights.items() for j in range(len(run) - n + 1)]
                    place += [i * dimension + slot(t) for t, _ in terms]
                    weight += [w for _, w in terms]
                v = np.bincount(np.array(place, np.int64), weight, minlength=len(part) * dimension).reshape(len(part), dimension)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                out += list(v / np.where(size > 0, size, 1))
            yield pd.Series(out, index=batch.index)

    return embed


def digest_embedding(c: Column, dimension: int = 32) -> Column:
    """At most 32 components from the bytes of SHA-256, centred and scaled to unit length; in the JVM."""
    h = F.sha2(c.cast("binary"), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(min(dimension, 32) - 1)), lambda i: (F.conv(h.substr(2 * i + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5)
    return F.transform(raw, lambda x: x / norm(raw))
