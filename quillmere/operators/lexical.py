"""BM25 with statistics of the caller's scope only.

The access filter comes before the corpus statistics: number of documents, document frequencies
and average length are those of the rows that are passed in. ``search`` answers a stated set of
queries from a stored index with score bounds (see ``postings``). ``scores`` gives every pair as rows,
for few or rare query terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .postings import Postings

K1, B = 1.2, 0.75
MAX_QUERY_TERMS = 64


def tokens(docs: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """key, terms, dl (number of terms)."""
    return docs.select(key, F.coalesce(terms, F.array().cast("array<string>")).alias("terms")).withColumn("dl", F.size("terms").cast("bigint"))


def _exploded(tokenized: DataFrame, key: str) -> DataFrame:
    """One row for each term. The outer form keeps the planner from adding a filter on the number of
    terms, which would tokenise every text twice."""
    return tokenized.select(key, "dl", F.explode_outer("terms").alias("term")).where("term is not null")


def term_frequency(tokenized: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings: key, term, tf, dl. The aggregation key starts with the row's own id, so map-side
    combining finishes it where rows of an id lie together."""
    return _exploded(tokenized, key).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, terms: Column, key: str = "query_id", limit: int | None = MAX_QUERY_TERMS) -> DataFrame:
    """Distinct terms of each query. Queries without terms or with more than ``limit`` are refused (left out);
    with ``limit=None`` queries of any length are taken."""
    n = F.size("terms")
    q = queries.select(key, F.array_distinct(terms).alias("terms")).where(n > 0 if limit is None else (n > 0) & (n <= limit))
    return q.select(key, F.explode("terms").alias("term"))


def rejected_queries(queries: DataFrame, terms: Column, key: str = "query_id", limit: int = MAX_QUERY_TERMS) -> DataFrame:
    """key, reason of the queries that ``query_terms`` leaves out: no_terms or too_many_terms."""
    q = queries.select(key, F.coalesce(F.size(F.array_distinct(terms)), F.lit(0)).alias("n"))
    return q.where((F.col("n") <= 0) | (F.col("n") > limit)).select(key, F.when(F.col("n") <= 0, "no_terms").otherwise("too_many_terms").alias("reason"))


def search(tokenized: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", k1: float = K1, b: float = B, digits: int = 9, query_block: int = 1024) -> DataFrame:
    """query, document, score, rank: the k best documents of each query with a score above zero, ties to
    the smaller id. ``queries`` is (query, term), one row a distinct term; ids are integers. Texts are
    tokenised once, for the index."""
    found = Postings(tokenized, key).search(queries, k, query_key, k1, b, digits, query_block)
    return top_k(found, k, key, query_key, digits)


def scores(tokenized: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "query_id", k1: float = K1, b: float = B) -> DataFrame:
    """query, document, score for every pair that shares a term.

    Only terms of some query are counted: the terms are first filtered by the queries' distinct
    terms, which keeps postings to what can score.
    """
    wanted = queries.select("term").distinct()
    hits = _exploded(tokenized, key).join(wanted, "term").groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    stats = tokenized.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    # One row of statistics: a broadcast of fixed size.
    weighted = df.join(F.broadcast(stats)).select("term", "avgdl", F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    q = queries.join(weighted, "term")
    part = F.col("idf") * (F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * (F.col("dl") / F.col("avgdl")))))
    return hits.join(q, "term").groupBy(query_key, key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id", digits: int = 9) -> DataFrame:
    """The k best of each query with a score above zero, by (score desc, id); rank from 1. Scores are
    compared rounded, so that the order of summation doesn't decide ties."""
    s = scored.where("score > 0").withColumn("score", F.round("score", digits))
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
