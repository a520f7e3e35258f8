"""A cache of answers as a table: digest, value, expires_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def refused(value: Column, most_bytes: int) -> Column:
    """Why a value is not stored: blank or too_large; null if it is."""
    return F.when(value.isNull() | (strip(value) == ""), "blank").when(F.octet_length(value) > most_bytes, "too_large")


def put(table: DataFrame | None, answers: DataFrame, now: Column, ttl_seconds: int, most_bytes: int = 1 << 20) -> DataFrame:
    """The table after ``answers`` (digest, value): an answer replaces the entry of its digest, refused values
    are left out, and expired entries go."""
    if ttl_seconds < 1:
        raise ValueError("an entry lives a second at least")
    new = answers.where(refused(F.col("value"), most_bytes).isNull()).groupBy("digest").agg(F.max("value").alias("value"))
    new = new.select("digest", "value", (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))
    return new if table is None else alive(table, now).join(new.select("digest"), "digest", "left_anti").unionByName(new)


def alive(table: DataFrame, now: Column) -> DataFrame:
    return table.where(F.col("expires_at") > now)


def get(table: DataFrame, asked: DataFrame, now: Column, most_bytes: int = 1 << 20) -> DataFrame:
    """``asked`` (digest) with value and outcome: hit, miss, or error for an entry that should not have been stored."""
    found = alive(table, now).select("digest", "value")
    j = asked.join(found.withColumn("__in", F.lit(True)), "digest", "left")
    bad = F.col("__in") & refused(F.col("value"), most_bytes).isNotNull()
    return j.withColumn("outcome", F.when(bad, "error").when(F.col("__in"), "hit").otherwise("miss")).withColumn("value", F.when(F.col("outcome") == "hit", F.col("value"))).drop("__in")
