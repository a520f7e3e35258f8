"""Rank fusion, reranking and the assembly of cited context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def reciprocal_rank(lists: DataFrame, k: int | None = None, constant: int = RANK_CONSTANT, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Fuse ranked lists (query, source, rank, key): the sum of 1 / (constant + rank) over sources, with
    the contributions of each source. Ordered by (score desc, key)."""
    part = 1.0 / (F.lit(constant) + F.col("rank"))
    fused = lists.groupBy(query, key).agg(F.sum(part).alias("raw"), F.array_sort(F.collect_list(F.struct("source", "rank", F.round(part, 9).alias("part")))).alias("signals"))
    fused = fused.withColumn("score", F.round("raw", 9)).drop("raw")
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def hybrid(channels: dict[str, DataFrame], k: int, candidates: int | None = None, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Fuse channels, each cut at the candidate window max(20, k) first. An empty channel adds nothing."""
    if candidates is not None and candidates < k:
        raise ValueError("candidates must be at least k")
    window = candidates or max(20, k)
    parts = [d.where(F.col("rank") <= window).select(query, F.lit(name).alias("source"), "rank", key) for name, d in channels.items()]
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.unionByName(p)
    return reciprocal_rank(lists, k, key=key, query=query)


def overlap_score(query_terms: Column, doc_terms: Column) -> Column:
    """Distinct query terms in the document over distinct query terms; 0 for no terms."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc_terms)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, score: Column | Callable[[DataFrame], DataFrame], k: int, query: str = "query_id") -> DataFrame:
    """Second-stage order by (score desc, original rank). ``score`` is a column (built-in or Arrow UDF)
    or a function that adds rerank_score to the whole batch."""
    s = candidates.withColumn("rerank_score", score) if isinstance(score, Column) else score(candidates)
    s = s.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", F.round("rerank_score", 9))
    order = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "original_rank")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cited_context(results: DataFrame, poisoned: Column, max_chunks: int = 5, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """The first ``max_chunks`` distinct results that aren't quarantined, numbered S1.. in rank order."""
    first = Window.partitionBy(query, key).orderBy("rank")
    once = results.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").where(~poisoned)
    numbered = once.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("rank", key)))
    return numbered.where(F.col("position") <= max_chunks).withColumn("source_id", F.concat(F.lit("S"), F.col("position").cast("string")))


def context_json(cited: DataFrame, fields: list[str], query: str = "query_id") -> DataFrame:
    """One compact JSON array of the cited records for each query, in order; at most max_chunks records."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct("source_id", *fields).alias("r")))), lambda x: x["r"])
    return cited.groupBy(query).agg(F.to_json(rows).alias("context"), F.count(F.lit(1)).alias("n_sources"))


def check_citations(answers: DataFrame, cited: DataFrame, answer: str = "answer", query: str = "query_id") -> DataFrame:
    """used, unknown and status of an answer's markers: ok, unknown_citation or no_citation."""
    have = cited.groupBy(query).agg(F.collect_set("source_id").alias("available"))
    used = F.array_distinct(F.regexp_extract_all(F.col(answer), F.lit(r"\[(S\d+)\]"), F.lit(1)))
    a = answers.join(have, query, "left").withColumn("used", used).withColumn("unknown", F.array_except("used", F.coalesce("available", F.array().cast("array<string>"))))
    status = F.when(F.size("unknown") > 0, "unknown_citation").when(F.size("used") == 0, "no_citation").otherwise("ok")
    return a.withColumn("status", status).drop("available")


def research_answer(internal: DataFrame, external: DataFrame, requested: Column, enabled: bool, max_results: int = 5, query: str = "query_id") -> DataFrame:
    """Internal evidence first; the web only where requested and enabled. Status: completed, partial or
    unavailable. ``internal``: query, n_sources; ``external``: query, url, position."""
    first = Window.partitionBy(query, "url").orderBy("position")
    web = external.withColumn("__n", F.row_number().over(first)).where("__n = 1").withColumn("w", F.row_number().over(Window.partitionBy(query).orderBy("position"))).where(F.col("w") <= max_results)
    counts = web.groupBy(query).agg(F.count(F.lit(1)).alias("n_web"))
    r = internal.withColumn("wants_web", requested).join(counts, query, "left")
    n_web = F.when(F.col("wants_web") & F.lit(enabled), F.coalesce("n_web", F.lit(0))).otherwise(F.lit(0))
    has_internal, lacks_web = F.coalesce("n_sources", F.lit(0)) > 0, F.col("wants_web") & (n_web == 0)
    status = F.when(~has_internal & (n_web == 0), "unavailable").when(lacks_web | ~has_internal, "partial").otherwise("completed")
    return r.select(query, F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_internal"), n_web.cast("bigint").alias("n_web"), status.alias("status"))


def merged_citations(first: DataFrame, second: DataFrame, key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Two lists of citations (query, key, position) as one: the first list before the second, each key once
    at its first place, numbered S1.. anew."""
    both = first.select(query, key, F.lit(0).alias("l"), "position").unionByName(second.select(query, key, F.lit(1).alias("l"), "position"))
    once = both.groupBy(query, key).agg(F.min(F.struct("l", "position")).alias("at"))
    n = F.row_number().over(Window.partitionBy(query).orderBy("at", key))
    return once.withColumn("position", n).withColumn("source_id", F.concat(F.lit("S"), n.cast("string"))).drop("at")
