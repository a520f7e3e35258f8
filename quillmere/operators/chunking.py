"""Ingestion: front matter, chapter and article segmentation, provenance, structure profile.

Segmentation is a running window inside each document over its lines: headings raise counters,
and lines are grouped by (document, article counter). A chapter heading closes the open article.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_NUM = "[一二三四五六七八九十百千零〇两0-9]+"
#: The headings that open chapters and articles.
CHAPTER = rf"^##\s+(第{_NUM}章(?:\s+.*?)?)\s*$"
ARTICLE = rf"^###\s+(第{_NUM}条)(?:\s+(.*?))?\s*$"


def split_front_matter(raw: Column) -> Column:
    """struct(header, body) of a text whose first line is ---; a byte-order mark and CRLF are tolerated."""
    t = F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), r"\r\n?", "\n")
    p = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    return F.struct(F.when(t.rlike(p), F.regexp_extract(t, p, 1)).alias("header"), F.when(t.rlike(p), F.regexp_extract(t, p, 2)).otherwise(t).alias("body"))


def flat_header(header: Column) -> Column:
    """map of the flat ``key: value`` lines of a header; quotes around values are dropped."""
    lines = F.filter(F.split(header, "\n"), lambda x: x.rlike(r"^\w[\w.-]*\s*:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w.-]+)\s*:", 1)), F.btrim(F.trim(F.regexp_extract(x, r"^[\w.-]+\s*:(.*)$", 1)), F.lit("\"'")))))


def nested_header(header: Column) -> Column:
    """A YAML header of any depth as struct(fields, error): a map of dotted keys (lists by number) to values as
    text, null where the header is no mapping, with the reason. An Arrow UDF; the parser is PyYAML."""
    import yaml

    def flat(value, name: str, out: dict[str, str | None]) -> None:
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if inner is None:
            out[name] = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        for k, v in inner or ():
            flat(v, f"{name}.{k}" if name else str(k), out)

    def one(text: str | None) -> dict:
        if text is None:
            return {"fields": None, "error": None}
        try:
            value = yaml.safe_load(text)
        except yaml.YAMLError as e:
            return {"fields": None, "error": type(e).__name__}
        if not isinstance(value, dict):
            return {"fields": None, "error": "empty" if value is None else "no_mapping"}
        out: dict[str, str | None] = {}
        flat(value, "", out)
        return {"fields": out, "error": None}

    @F.pandas_udf("fields map<string, string>, error string")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["fields", "error"])

    return parsed(header)


#: Plain headings of extracted text, what ends a sentence, and the longest article title.
PLAIN_CHAPTER, PLAIN_ARTICLE = rf"^第{_NUM}章(?: +.*)?$", rf"^(第{_NUM}条)(?: +(.*))?$"
SENTENCE_END, TITLE_LENGTH = "[。！？；;!?.]", 24


def heading_lines(line: Column) -> Column:
    """The lines that an extracted line stands for: white space collapsed, a plain chapter or article as a
    heading, and an article's text that is no title on a line of its own."""

    def rewritten(n: Column) -> Column:
        label, rest = F.regexp_extract(n, PLAIN_ARTICLE, 1), T.strip(F.regexp_extract(n, PLAIN_ARTICLE, 2))
        title = (F.length(rest) <= TITLE_LENGTH) & ~rest.rlike(SENTENCE_END)
        article = F.when(rest == "", F.array(F.concat(F.lit("### "), label))).when(title, F.array(F.concat(F.lit("### "), label, F.lit(" "), rest))).otherwise(F.array(F.concat(F.lit("### "), label), rest))
        return F.when(n.startswith("#"), F.array(n)).when(n.rlike(PLAIN_CHAPTER), F.array(F.concat(F.lit("## "), n))).when(n.rlike(PLAIN_ARTICLE), article).otherwise(F.array(n))

    return F.transform(F.array(T.collapse(line)), rewritten)[0]


def trimmed(lines: Column, **maps: Column) -> Column:
    """struct(body, then each map): a text's lines without blank ones at its edges, and the arrays that map
    its lines cut in the same way. Null where the body is blank or a map has another length."""
    blank = lambda x: T.strip(x) == ""
    full = F.filter(F.transform(lines, lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
    first, last = F.array_min(full), F.array_max(full)
    cut = lambda a: F.slice(a, first + 1, last - first + 1)
    fits = F.size(full) > 0
    for m in maps.values():
        fits = fits & (m.isNull() | (F.size(m) == 0) | (F.size(m) == F.size(lines)))
    parts = [F.array_join(cut(lines), "\n").alias("body"), *[F.when(F.size(m) > 0, cut(m)).otherwise(m).alias(k) for k, m in maps.items()]]
    return F.when(fits, F.struct(*parts))


def policy_problems(documents: DataFrame, needed: tuple[str, ...], key: str = "document_id") -> DataFrame:
    """key, problem of documents' metadata: a repeated id, a missing field, an expiry before the date of effect."""
    twice = documents.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated_id").alias("problem"))
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(T.strip(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing_{c}")) for c in needed], F.when(F.col("expiry") < F.col("effective"), F.lit("expiry_before_effect"))))
    return twice.unionByName(documents.select(key, F.explode(lacks).alias("problem")))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1), line."""
    split = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    return docs.select(key, F.posexplode(split).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def segment(line_rows: DataFrame, chapter: str = CHAPTER, article: str = ARTICLE, key: str = "doc_id") -> DataFrame:
    """One row for each article: chapter_index, chapter_title, article_index, article_label, article_title,
    line_start, line_end, content, orphan (no chapter stands before it)."""
    s = F.trim(F.col("line"))
    l = line_rows.withColumn("is_chapter", s.rlike(chapter)).withColumn("is_article", s.rlike(article) & ~s.rlike(chapter))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("chapter_index", F.sum(F.col("is_chapter").cast("int")).over(w)).withColumn("article_index", F.sum(F.col("is_article").cast("int")).over(w))
    l = l.withColumn("chapter_title", F.last(F.when(F.col("is_chapter"), F.trim(F.regexp_extract(s, chapter, 1))), ignorenulls=True).over(w))
    opened = F.last(F.when(F.col("is_article"), F.col("line_no")), ignorenulls=True).over(w)
    closed = F.last(F.when(F.col("is_chapter"), F.col("line_no")), ignorenulls=True).over(w)
    l = l.withColumn("inside", opened.isNotNull() & (closed.isNull() | (opened > closed))).where("inside")
    head = F.min_by(s, "line_no")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    a = l.groupBy(key, "article_index").agg(F.min("chapter_index").alias("chapter_index"), F.first("chapter_title", ignorenulls=True).alias("chapter_title"), head.alias("head"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), body.alias("content"))
    label = F.regexp_extract("head", article, 1)
    title = F.trim(F.regexp_extract("head", article, 2))
    return a.withColumn("article_label", label).withColumn("article_title", F.when(title == "", label).otherwise(title)).withColumn("orphan", F.col("chapter_index") == 0).withColumn("content", F.regexp_replace("content", r"^\s*\n|\s+$", "")).drop("head")


def chunk_id(document_id: Column, version: Column, index: Column) -> Column:
    return F.concat(document_id, F.lit("__v"), T.normalized_version(version), F.format_string("__article_%03d", index.cast("int")))


def retrieval_text(title: Column, document_id: Column, version: Column, chapter: Column, label: Column, article: Column, content: Column) -> Column:
    head = [F.concat(F.lit("制度："), title), F.concat(F.lit("制度编号："), document_id), F.concat(F.lit("版本："), version), F.concat(F.lit("章节："), chapter), F.concat(F.lit("条款："), label, F.lit(" "), article)]
    return F.trim(F.concat_ws("\n", *head, F.lit(""), content))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def line_range(mapping: Column, start: Column, end: Column) -> Column:
    """struct(low, high) of the pages or blocks that lines start..end (from 1) map to."""
    part = F.slice(mapping, start, end - start + 1)
    return F.struct(F.array_min(part).alias("low"), F.array_max(part).alias("high"))


def ocr_provenance(units: Column, low: Column, high: Column) -> Column:
    """struct(units, confidence): units (unit, confidence) of a range with their lowest confidence."""
    inside = F.filter(units, lambda u: (u["unit"] >= low) & (u["unit"] <= high))
    return F.struct(F.array_sort(F.array_distinct(F.transform(inside, lambda u: u["unit"]))).alias("units"), F.array_min(F.transform(inside, lambda u: u["confidence"])).alias("confidence"))


def structure_profile(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines, headings by level, chapters and articles of each document."""
    s = F.trim(F.col("line"))
    level = F.length(F.regexp_extract(s, r"^(#{1,6})\s", 1))
    counts = [F.count_if(level == n).alias(f"h{n}") for n in range(1, 7)]
    return line_rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(s == "").alias("n_blank"), *counts, F.count_if(s.rlike(CHAPTER)).alias("n_chapters"), F.count_if(s.rlike(ARTICLE)).alias("n_articles"), F.max(F.length("line")).cast("bigint").alias("longest_line"))
