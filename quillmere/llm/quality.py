"""Quality selection by importance resampling.

Two hashed n-gram generative models (words and word pairs) are counted: one on target text,
one on all raw text. A document's log weight is the sum over its n-grams of log target
probability minus log raw probability. Gumbel noise, fixed by the document's id, turns a
top-k by (weight + noise) into a sample without replacement in proportion to the weights.

The raw model counts every document. The target model counts at most ``max_target`` labelled
documents (a documented bound), whose ids are therefore small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import Workspace

_TABLE = tk.byte_table(11)
_PAIR = tk.U64(0x9FB21C651E98DF25)


def ngram_slots(chunk: tk.Chunk, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document of every lower-cased word and pair of neighbouring words."""
    h, _, _, doc = tk.word_sequence(chunk, _TABLE, tk.LOWER[chunk.data])
    same = doc[1:] == doc[:-1]
    pair = tk.mix(h[:-1] * _PAIR + h[1:])[same]
    return (np.concatenate([h, pair]) % tk.U64(slots)).astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def _count(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        for b in batches:
            wanted = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for chunk in tk.chunks(b.column(0)):
                at, doc = ngram_slots(chunk, slots)
                raw += np.bincount(at, minlength=slots)
                target += np.bincount(at[wanted[chunk.first + doc]], minlength=slots)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["slot", "raw", "target"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            weight, count = [], []
            for chunk in tk.chunks(b.column(1)):
                at, doc = ngram_slots(chunk, len(ratio))
                weight.append(np.bincount(doc, ratio[at], minlength=chunk.n))
                count.append(np.bincount(doc, minlength=chunk.n))
            both = [np.concatenate(x) if x else np.zeros(0) for x in (weight, count)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(both[0].astype(float)), pa.array(both[1].astype(np.int64))], ["doc_id", "log_weight", "n_grams"])

    return run


def _cutoff(rows: DataFrame, column: str, wanted: int, descending: bool, bins: int, small: int) -> tuple[object, int]:
    """The value of ``column`` that the wanted-th row has in order, and how many rows come before that
    value. Histograms narrow the range; only a range of at most ``small`` rows is counted value by value."""
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    before = 0
    while hi > lo and n > small:
        spot = F.least(F.floor((F.col(column).cast("double") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        found = rows.where(F.col(column).between(lo, hi)).groupBy(spot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b") if descending else F.asc("b")).collect()
        for r in found:
            if before + r["n"] >= wanted:
                break
            before += r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break  # as narrow as doubles tell apart
        lo, hi, n = r["lo"], r["hi"], r["n"]
    # Few rows, or few values.
    for r in rows.where(F.col(column).between(lo, hi)).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(column) if descending else F.asc(column)).toLocalIterator():
        if before + r["n"] >= wanted:
            return r[column], before
        before += r["n"]
    raise AssertionError("fewer rows than wanted")


def top_by_key(rows: DataFrame, key: str, tie: str, k: int, bins: int = 1024, small: int = 100_000) -> DataFrame:
    """``rows`` with ``selected``: the k highest keys, ties to the smaller ``tie`` (null first), then to
    the row's place. Cutoffs of key, tie and place are found by histograms one after the other, so
    no row is shuffled, and equal keys of any number are no group of their own. ``rows`` must be
    read alike each time, as a stored table is."""
    if rows.count() <= k:
        return rows.withColumn("selected", F.lit(True))
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    placed = rows.withColumn("__place", F.monotonically_increasing_id()).withColumn("__known", F.col(tie).isNotNull().cast("int")).withColumn("__tie", F.coalesce(tie, F.lit(0)))
    left, chosen, edge = placed, F.lit(False), F.lit(True)
    for column, descending in ((key, True), ("__known", False), ("__tie", False), ("__place", False)):
        cut, before = _cutoff(left, column, k, descending, bins, small)
        chosen = chosen | (edge & (F.col(column) > F.lit(cut) if descending else F.col(column) < F.lit(cut)))
        edge = edge & (F.col(column) == F.lit(cut))
        k -= before
        left = left.where(F.col(column) == F.lit(cut))
    return placed.withColumn("selected", chosen | edge).drop("__place", "__known", "__tie")


def importance_resample(docs: DataFrame, target_ids: DataFrame, fraction: float = 0.5, doc_id: str = "doc_id", text: str = "text", slots: int = 10_000, max_target: int = 20_000, seed: int = 17) -> DataFrame:
    """doc_id, log_weight, n_grams, resample_key, selected for every row of ``docs``.

    ``target_ids`` (column doc_id) names the target documents; those with the ``max_target``
    smallest hashed ids are used. floor(fraction * rows) rows are selected. A null or empty text
    has weight 0, and so ranks by its noise alone. Rows that repeat an id share its noise, and so do
    rows with a null id; of equal keys the smaller id goes first. An empty table gives no row; a very
    long text is counted whole. Only id and text are read, so other columns of any name don't matter.
    """
    spark = docs.sparkSession
    chosen = target_ids.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    wanted = F.broadcast(chosen.withColumn("__target", F.lit(True)).withColumnRenamed("doc_id", "__id"))
    flagged = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).join(wanted, F.col("doc_id") == F.col("__id"), "left")
    counts = flagged.select("t", F.coalesce("__target", F.lit(False)).alias("target")).mapInArrow(_count(slots), "slot bigint, raw bigint, target bigint").groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(slots), np.ones(slots)  # add-one smoothing
    for r in counts:
        raw[r["slot"]] += r["raw"]
        target[r["slot"]] += r["target"]
    shared = spark.sparkContext.broadcast(np.log(target / target.sum()) - np.log(raw / raw.sum()))
    scored = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).mapInArrow(_score(shared), "doc_id bigint, log_weight double, n_grams bigint")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = scored.withColumn("resample_key", F.col("log_weight") - F.log(-F.log(uniform)))
    table = Workspace(spark, "quality").write(keyed, "scored")
    return top_by_key(table, "resample_key", "doc_id", int(fraction * table.count()))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Half of all documents, resampled towards the documents labelled as good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality") == 1)
    return importance_resample(docs, good)
