"""Retrieval and answer evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.size(F.array_distinct(relevant))


def reciprocal_rank(retrieved: Column, relevant: Column, k: int) -> Column:
    """1 / place of the first relevant result within k, else 0."""
    top = F.slice(retrieved, 1, k)
    gains = F.transform(top, lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / (i + 1)).otherwise(0.0))
    return F.coalesce(F.array_max(gains), F.lit(0.0))


def per_case(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """``results`` (retrieved, relevant arrays) with recall_k for each k and mrr at the largest k."""
    out = results
    for k in ks:
        out = out.withColumn(f"recall_{k}", recall_at(F.col("retrieved"), F.col("relevant"), k))
    return out.withColumn("mrr", reciprocal_rank(F.col("retrieved"), F.col("relevant"), max(ks)))


def channel_summary(cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5), gate_recall: float = 0.8, gate_mrr: float = 0.8) -> DataFrame:
    """Macro averages of each channel, its errors and whether it passes the gate."""
    means = [F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks]
    s = cases.groupBy("channel").agg(F.count(F.lit(1)).alias("n_cases"), *means, F.round(F.avg("mrr"), 6).alias("mrr"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    return s.withColumn("passed", (F.col(f"recall_{max(ks)}") >= gate_recall) & (F.col("mrr") >= gate_mrr) & (F.col("n_errors") == 0))


def unknown_judgments(cases: DataFrame, rows: DataFrame, allowed: DataFrame, relevant: str = "relevant", key: str = "doc_id") -> DataFrame:
    """case, id, problem: judged ids that don't exist, or that the identity may not see."""
    judged = cases.select("case_id", F.explode(relevant).alias(key))
    missing = judged.join(rows.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    hidden = judged.join(rows.select(key), key, "left_semi").join(allowed.select(key), key, "left_anti").withColumn("problem", F.lit("not_authorised"))
    return missing.unionByName(hidden)


def _found(channel: DataFrame | Callable[[], DataFrame], key: str, most: int) -> tuple[DataFrame | None, str | None]:
    """A channel's ranked ids of each case, computed and stored, or what it failed with."""
    try:
        ranked = channel if isinstance(channel, DataFrame) else channel()
        top = ranked.where(F.col("rank") <= most).groupBy(F.col("query_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key]).alias("retrieved"))
        return (top if isinstance(channel, DataFrame) else cut(top)), None
    except Exception as e:  # whatever stops one channel is its result, and the others are measured
        return None, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}".rstrip(": ")


def retrieval_report(channels: dict[str, DataFrame | Callable[[], DataFrame]], cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5), key: str = "doc_id") -> DataFrame:
    """Every case in every channel: case_id, channel, retrieved, relevant, recall at each k, mrr and error.

    ``channels`` are ranked rows (query_id, key, rank); a case that a channel finds nothing for is
    there with nothing retrieved. A channel may be a function that gives the rows: it is run at once, and
    one that fails has every case there with nothing retrieved and what it failed with as error.
    ``cases``: case_id, relevant (array). Feed it to ``channel_summary``.
    """
    if not ks or min(ks) < 1 or not channels:
        raise ValueError("an evaluation has channels and positive depths")
    parts, same = [], cases.schema["relevant"].dataType
    for name, channel in channels.items():
        top, error = _found(channel, key, max(ks))
        none = F.array().cast(same if top is None else top.schema["retrieved"].dataType)
        joined = cases.withColumn("retrieved", none) if top is None else cases.join(top, "case_id", "left")
        parts.append(joined.select("case_id", F.lit(name).alias("channel"), F.coalesce("retrieved", none).alias("retrieved"), "relevant", F.lit(error).cast("string").alias("error")))
    return per_case(reduce(DataFrame.unionAll, parts), ks)


def run_cases(cases: DataFrame, predict: Callable[[DataFrame], DataFrame], metrics: dict[str, Callable[[], Column]]) -> DataFrame:
    """case_id, metric, passed of every golden case: ``predict`` adds the predictions, ``metrics`` are tests
    of predicted against expected columns. A metric that a case has no expectation for is null and left
    out; a case that ``predict`` marks in its error column fails all of its metrics."""
    p = predict(cases)
    error = F.col("error").isNotNull() if "error" in p.columns else F.lit(False)
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(test().isNotNull(), ~error & F.coalesce(test(), F.lit(False))).alias("passed")) for m, test in metrics.items()])
    return p.select("case_id", F.inline(each)).where("passed is not null")


def golden(cases: DataFrame, runners: dict[str, Callable[[DataFrame], DataFrame]], metrics: dict[str, dict[str, Callable[[], Column]]], category: str = "category") -> DataFrame:
    """case_id, metric, passed over cases of several categories, each with its own runner and metrics.

    A runner adds predictions (and perhaps an error column) to the cases of its category. Each metric of a
    category is judged where the case expects something; a runner that fails fails every metric that its
    cases could have, a case of a category without a runner is an error."""
    if unknown := [r[0] for r in cases.where(~F.coalesce(F.col(category).isin(*runners), F.lit(False))).select(category).distinct().limit(5).collect()]:
        raise ValueError(f"no runner for {', '.join(map(str, unknown))}")
    parts = []
    for name, run in runners.items():
        mine = cases.where(F.col(category) == name)
        try:
            parts.append(cut(run_cases(mine, run, metrics[name])))
        except Exception:  # what stops a runner fails its category, and the others are judged
            failed = F.explode(F.array(*[F.lit(m) for m in metrics[name]])).alias("metric")
            parts.append(mine.select("case_id", failed, F.lit(False).alias("passed")))
    return reduce(DataFrame.unionByName, parts)


def metric_summary(dimensions: DataFrame, metrics: dict[str, float]) -> DataFrame:
    """passed, total and accuracy of every metric in ``metrics`` (name: target), also those without cases."""
    seed = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(t)).alias("target")) for m, t in metrics.items()])).alias("s")
    named = dimensions.sparkSession.range(1).select(seed).select("s.*")
    got = dimensions.groupBy("metric").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    s = named.join(got, "metric", "left").select("metric", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total"), "target")
    acc = F.when(F.col("total") > 0, F.round(F.col("passed") / F.col("total"), 6)).otherwise(F.lit(0.0))
    return s.withColumn("accuracy", acc).withColumn("met", (F.col("total") > 0) & (F.col("accuracy") >= F.col("target"))).drop("target")


def case_passes(assertions: DataFrame) -> DataFrame:
    """A case passes when all of its assertions do."""
    return assertions.groupBy("case_id").agg(F.every("passed").alias("passed"))


def citation_dimension(actual: Column, expected: Column) -> Column:
    """Citations (struct id, key) are right when the keys are the expected set, the ids run S1..n and no key repeats."""
    ids, keys = actual.getField("source_id"), actual.getField("key")
    n = F.size(actual)
    run = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("S"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return (F.array_sort(keys) == F.array_sort(expected)) & (ids == run) & (F.size(F.array_distinct(keys)) == n)
