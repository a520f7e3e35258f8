"""Token counts: an exact length histogram that answers questions for every context limit.

The corpus is encoded once. Documents are counted by encoded length, the histogram is written,
and sums over it give totals, quantiles and truncated totals for any limit with no second pass.
A null or empty text has length 0; special-token strings in a text are ordinary text. Each row
counts, whether or not ids repeat or are null; an empty table gives an empty histogram. A task
holds one Arrow batch of texts, so a very long text costs memory in proportion to it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[int, object] = {}


def _encoder(raw: bytes):
    key = hash(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_lengths(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` columns and n_tokens of every row. The vocabulary (about 1 MB) is read once and broadcast."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens bigint"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared.value)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(encode, schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row for each encoded length that occurs. The histogram is written, as the
    sums read it twice."""
    counted = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return Workspace(lengths.sparkSession, "tokens").write(counted, "histogram")


def context_table(histogram: DataFrame, block: int = 256) -> DataFrame:
    """For each length L that occurs: documents and tokens at or above L (suffix sums), documents
    up to L, and the total when every document is cut at L. Sums run in blocks of ``block``
    lengths, then over blocks, so that no task holds the whole histogram."""
    h = histogram.withColumn("blk", F.expr(f"n_tokens div {block}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("blk").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # One row per block of lengths: a few hundred for documents of up to 100,000 tokens.
    after = Window.orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("blk", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("at"), F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"))
    within = Window.partitionBy("blk").orderBy(F.col("n_tokens").desc())
    s = h.join(blocks, "blk").select("n_tokens", "n_docs", "all_docs", "all_tokens", (F.sum("n_docs").over(within) + F.col("ad")).alias("docs_ge"), (F.sum("tokens").over(within) + F.col("at")).alias("tokens_ge"))
    return s.select(
        "n_tokens",
        "n_docs",
        F.col("docs_ge").cast("bigint"),
        F.col("tokens_ge").cast("bigint"),
        (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).cast("bigint").alias("docs_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).cast("bigint").alias("truncated_tokens"),
    )


def total(table: DataFrame) -> DataFrame:
    """n_docs and n_tokens of the corpus, from the context table."""
    return table.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("n_tokens"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at ``limit`` (any limit, not only one that occurs)."""
    cut: Column = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return table.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_tokens"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a fraction q of the documents do not exceed (nearest rank)."""
    enough = F.col("docs_le") >= F.ceil(F.lit(float(q)) * (F.col("docs_le") + F.col("docs_ge") - F.col("n_docs")))
    return table.where(enough).agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Length histogram and suffix sums of all documents under the byte-level BPE vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return context_table(length_histogram(token_lengths(docs, keep=())))
