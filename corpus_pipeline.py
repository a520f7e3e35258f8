"""A corpus pipeline of five stages over ``documents``: each works on all that the one before kept.

language_id     documents that no known language is near go
line_dedup      a line that several documents hold stays in the first of them
simhash         one document of each near-duplicate component stays
decontaminate   documents that hold a benchmark item go
mix             words are taken from the sources by target weights

A stage works on any input with the columns of documents and more: a column of its own making that the
input has as well is kept aside, so the input's columns come out as they went in. An empty input gives
an empty result. What a stage does with nulls, long texts and repeated rows is its operator's docstring;
rows with a null id are never taken for copies or repeats of one another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import decontam, langid, linededup, mixing, simhash
from quillmere.llm.workspace import Workspace, aside

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` with all but the table's own columns under other names, and back."""
    held, own = aside(docs, *COLUMNS)
    out = work(held)
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a known language; the model learns from the labelled documents of this input.
    Null and empty texts, and texts without a letter, go. Where no row is labelled nothing is known, and
    every document stays."""
    model = langid.fit(docs)
    return _aside(docs, lambda d: langid.predict(d, model).where(~F.col("rejected")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; n_chars follows the text. A null text stays null."""

    def work(d: DataFrame) -> DataFrame:
        kept = linededup.dedup_lines(d)
        text = F.when(F.col("text").isNotNull(), F.col("kept"))
        changed = {"text": text, "n_chars": F.length(text).cast("bigint")}
        return kept.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in d.columns])

    return _aside(docs, work)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near copies, and one row of a repeated id."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


MIXED = ("size", "source_size", "target", "taken", "first_slot")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target, taken and first_slot, which
    replace columns of these names. Rows of one id share their sum."""
    sums = {"taken": F.sum("taken"), "first_slot": F.min("first_slot")}
    held, own = aside(docs.drop(*MIXED), *COLUMNS)
    taken = mixing.Mix(held).taken().groupBy(F.col("doc_id").alias("__id")).agg(*[sums.get(c, F.max(c)).alias(c) for c in MIXED])
    mixed = held.join(taken.where("taken > 0"), F.col("doc_id").eqNullSafe(F.col("__id")))
    return mixed.select(*[F.col(n).alias(c) for c, n in own.items()], *MIXED)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]

#: Language ID and SimHash have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name)
        space.release()
    return STAGES[-1][1](spark, docs, sf_dir)
