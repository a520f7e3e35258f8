"""Language ID by nearest centroid over normalised TF-IDF vectors of hashed letter n-grams.

Each language has several centroids (spherical k-means), so that a language with distinct
registers is not one blurred mean. A document goes to the language of the nearest centroid by
cosine; a document too far from it for its language is flagged ``rejected``, and one without any
letter is ``und``. Whole texts are read, a very long one in pieces; only the fit uses a sample, of
at most ``per_language`` rows a language. Each row is predicted by itself, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import aside

UNDETERMINED = "und"
_FOLD = tk.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])


def ngram_counts(chunk: tk.Chunk, dims: int, piece: int = 1 << 22) -> np.ndarray:
    """Counts of hashed 2- and 3-byte letter n-grams, one row per document. Bytes that are no
    letters are one separator each; an n-gram of separators only is left out. A text of over
    ``piece`` bytes is counted piece by piece."""
    out = np.zeros((chunk.n, dims))
    for at in range(0, len(chunk.data), piece):
        data, bounds = chunk.data[at : at + piece + 2], np.clip(chunk.bounds - at, 0, len(chunk.data[at : at + piece + 2]))
        out += _piece_counts(data, bounds, chunk.n, dims, piece)
    return out


def _piece_counts(data: np.ndarray, bounds: np.ndarray, n: int, dims: int, most: int) -> np.ndarray:
    """Counts of the n-grams that start in the first ``most`` bytes."""
    b = _FOLD[data].astype(np.uint32)
    size = len(b)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * dims)
    for k in (2, 3):
        if size < k:
            continue
        m = min(size - k + 1, most)
        code = b[:m].copy()
        for j in range(1, k):
            code = code << np.uint32(8) | b[j : j + m]
        blank = np.uint32(0x2020 if k == 2 else 0x202020)
        inside = (doc[:m] == doc[k - 1 : k - 1 + m]) & (code != blank)
        slot = ((code + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(16)
        out += np.bincount((doc[:m] * dims + slot % np.uint32(dims))[inside], minlength=n * dims)
    return out.reshape(n, dims)


def has_letter(chunk: tk.Chunk) -> np.ndarray:
    letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[chunk.data])])
    found = letters[chunk.bounds[1:]] > letters[chunk.bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in chunk.text(i).decode("utf-8", "replace"))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from the mean's nearest row, then the farthest rows. Deterministic."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c = _unit(c)
    return c


@dataclass
class Model:
    labels: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray  # of each centroid's language
    full: int = 1024  # n-grams from which the bound holds in full

    def bound(self, counts: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The rejection bound; the cosine of a short text is low by chance, as the root of its n-grams."""
        return self.reject_below[best] * np.sqrt(np.minimum(1.0, counts.sum(axis=1) / self.full))

    def score(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and cosine of each row; ties go to the first centroid."""
        sims = _unit(np.log1p(counts) * self.idf).astype(np.float32) @ self.centroids.T
        best = np.argmax(sims, axis=1)
        return best, np.clip(sims[np.arange(len(best)), best], 0, 1)


def _features(dims: int):
    """label, order, text -> label, order, packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in tk.chunks(b.column(2), max_docs=512):
                counts = ngram_counts(chunk, dims)
                at = [np.flatnonzero(c) for c in counts]
                packed = [np.concatenate([i, c[i]]).astype(np.int32).tobytes() for c, i in zip(counts, at, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(chunk.first, chunk.n) for j in (0, 1)), pa.array(packed, pa.binary())], ["label", "chance", "counts"])

    return run


def fit(docs: DataFrame, label: str = "lang", doc_id: str = "doc_id", text: str = "text", dims: int = 4096, centroids: int = 3, per_language: int = 400, max_languages: int = 500, reject_share: float = 0.8) -> Model:
    """Fit on at most ``per_language`` rows of each label, those with the smallest hashes of id and text, and
    on at most ``max_languages`` labels, those with the most rows: a bounded sample. Rows that repeat
    an id and a text count once.

    The bound of a language is ``reject_share`` of the cosine that 99 of 100 of its fitted rows
    reach; for a text of few n-grams it falls with the root of their number. With no labelled
    row the model has no language, and every document is undetermined but none is rejected.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    chance = F.xxhash64(F.col(doc_id), F.col(text))
    hashed = known.select(F.col(label).alias("label"), chance.alias("chance"))
    # One row a language, at most max_languages of them.
    sizes = hashed.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("chance").alias("least")).orderBy(F.desc("n"), "label").limit(max_languages).collect()
    if not sizes:
        return Model([], np.zeros((0, dims), np.float32), np.ones(dims), np.zeros(0))
    # The hash up to which a label's sample goes. Hashes below four times its share are few whatever the input's
    # size, and copies of a row share one; a label of copies only has its least hash.
    share = F.create_map(*[F.lit(x) for name, n, _ in sizes for x in (name, min(1.0, 4.0 * per_language / n))])
    few = hashed.where((F.col("chance") / float(1 << 64) + 0.5) < share[F.col("label")]).groupBy("label", "chance").count()
    order = Window.partitionBy("label").orderBy("chance")
    bound = dict(few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).groupBy("label").agg(F.max("chance")).collect())
    upto = F.create_map(*[F.lit(x) for name, _, least in sizes for x in (name, max(least, bound.get(name, least)))])
    drawn = known.withColumn("__chance", chance).where(F.col("__chance") <= upto[F.col(label)])
    counted = drawn.select(F.col(label).alias("label"), F.col("__chance").alias("chance"), F.col(text).alias("t")).mapInArrow(_features(dims), "label string, chance bigint, counts binary")
    # Copies become one in the task; at most max_languages * per_language rows by construction.
    rows = counted.groupBy("label", "chance").agg(F.min("counts").alias("counts")).orderBy("label", "chance").collect()
    x = np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        at, n = np.frombuffer(r["counts"], np.int32).reshape(2, -1)
        x[i, at] = n
    names = np.array([r["label"] for r in rows])
    x, names = x[x.any(axis=1)], names[x.any(axis=1)]
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    v = _unit(np.log1p(x) * idf)
    labels, cents, below = [], [], []
    for name in sorted(set(names.tolist())):
        mine = v[names == name]
        c = spherical_kmeans(mine, centroids)
        cents.append(c)
        labels += [name] * len(c)
        below += [reject_share * float(np.quantile((mine @ c.T).max(axis=1), 0.01))] * len(c)
    return Model(labels, np.concatenate(cents).astype(np.float32) if cents else np.zeros((0, dims), np.float32), idf, np.array(below))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected (score below the bound of the language,
    no letter, or no n-gram, as a text of one letter). A column of ``docs`` that has one of these three names is replaced. A null or empty
    text is ``und`` and rejected. A model without languages predicts ``und`` and rejects nothing. An
    empty table gives no row, and repeated rows are predicted each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src, own = aside(docs.drop("lang_pred", "score", "rejected"), text)
    names, place = src.columns, src.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema), "lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dims = len(m.idf)
        for b in batches:
            label, score, bound, empty = [], [], [], []
            for chunk in tk.chunks(b.column(place), max_docs=512):
                ok = has_letter(chunk)
                if not m.labels:
                    label += [UNDETERMINED] * chunk.n
                    score.append(np.zeros(chunk.n))
                    bound.append(np.zeros(chunk.n))
                    continue
                counts = ngram_counts(chunk, dims)
                best, s = m.score(counts)
                empty.append(~counts.any(axis=1))
                bound.append(m.bound(counts, best))
                label += [m.labels[j] if o else UNDETERMINED for j, o in zip(best, ok, strict=True)]
                score.append(np.where(ok, s, 0.0))
            score = np.concatenate(score).astype(float) if score else np.zeros(0)
            bad = np.zeros(len(label), bool)
            if m.labels and label:
                bad = (score < np.concatenate(bound)) | (np.array(label, object) == UNDETERMINED) | np.concatenate(empty)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.string()), pa.array(score), pa.array(bad, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in own.items()], "lang_pred", "score", "rejected")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the two thirds of documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    p = predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
