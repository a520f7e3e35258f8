"""Derived tables that several plans share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access
from ..session import table

AS_OF = "2024-06-30"
IDENTITY = {"department": "src0", "roles": ["EMPLOYEE"], "rank": 2, "region": "en"}


def governed(spark, sf_dir: str) -> DataFrame:
    """documents with access attributes derived from their ids, languages and sources. Some levels are
    unknown, some scopes, states and regions missing."""
    d = table(spark, sf_dir, "documents")
    effective = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))
    return d.select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("doc_id") % 103 == 1, None).when(F.col("doc_id") % 10 == 9, "draft").otherwise("effective").alias("status"),
        effective.alias("effective"),
        F.when(F.col("doc_id") % 3 == 0, F.date_add(effective, 180)).alias("expiry"),
        access.level_rank(F.when(F.col("doc_id") % 89 == 3, "Cores").otherwise(F.get(F.array(F.lit("public"), F.lit(" Internal"), F.lit("SENSITIVE"), F.lit("core\t")), (F.col("doc_id") % 4).cast("int")))).alias("rank"),
        F.when(F.col("doc_id") % 101 == 2, None).when(F.col("doc_id") % 2 == 0, F.array(F.lit(" all"))).otherwise(F.array(F.lower("source"), F.lit(" "))).alias("departments"),
        F.array(F.lit("EMPLOYEE"), F.lit("MANAGER")).alias("roles"),
        F.when(F.col("doc_id") % 97 == 4, F.when(F.col("doc_id") % 2 == 0, " ")).otherwise(F.concat(F.lit("\t"), F.upper("lang"))).alias("region"),
    )


GOVERNED = """
g AS (
  SELECT doc_id, text, lang, source,
         CASE WHEN doc_id % 103 = 1 THEN NULL WHEN doc_id % 10 = 9 THEN 'draft' ELSE 'effective' END AS status,
         DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS effective,
         CASE WHEN doc_id % 3 = 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) + 180 END AS expiry,
         CASE WHEN doc_id % 89 <> 3 THEN CAST(doc_id % 4 AS INTEGER) END AS rank,
         doc_id % 2 = 0 AND doc_id % 101 <> 2 AS everyone, doc_id % 101 = 2 AS nobody, doc_id % 97 = 4 AS anywhere
  FROM documents
)"""

ALLOWED = f"""
allowed AS (
  SELECT * FROM g
  WHERE status = 'effective' AND effective <= DATE '{AS_OF}' AND (expiry IS NULL OR expiry >= DATE '{AS_OF}')
    AND rank <= 2 AND (everyone OR (NOT nobody AND upper(source) = 'SRC0')) AND (anywhere OR lower(lang) = 'en')
)"""

TERMS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+(?:[._/-][a-z0-9]+)*')"


def benchmark_queries(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def terms(column: str):
    return T.latin_terms(F.col(column))
