"""Text functions on columns. Everything runs in the JVM except Unicode NFKC and case folding,
for which Spark has no built-in; those go through an Arrow UDF only where a text is not ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ideographs that make bigrams, and what a term is.
CJK = r"㐀-䶿一-鿿"
SEGMENT = rf"[a-z0-9]+(?:[._/-][a-z0-9]+)*|[{CJK}]+"
#: Characters without width that a scan leaves out.
ZERO_WIDTH = r"[\u200b-\u200f\u2060\ufeff]"
#: What stripping takes off both ends: white space of any script and the ASCII separators.
BLANK = r"[\s\x1c-\x1f]"


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: ASCII and the characters of Latin-1 that normalisation and scanning leave as they are.
STABLE = "[\\x00-\\x7F\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff]"


def is_stable(c: Column) -> Column:
    """Whether a text is its own NFKC form by its characters alone: no compatibility forms, and no marks to
    compose. Null is not."""
    return F.coalesce(is_ascii(c) | c.rlike(rf"\A{STABLE}*\z"), F.lit(False))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def fold(c: Column) -> Column:
    """NFKC and case folding of any Unicode text. The Arrow UDF sees null for ASCII rows."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(_fold(F.when(~is_ascii(c), c)))


def nfkc(c: Column) -> Column:
    return F.when(is_ascii(c), c).otherwise(_nfkc(F.when(~is_ascii(c), c)))


def fold_latin(c: Column) -> Column:
    """Case folding for Latin text, in the JVM: lower case with sharp s spelt out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def segments(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"({SEGMENT})"), F.lit(1))


def _parts(seg: Column) -> Column:
    """Terms of one segment: an identifier whole; a CJK run whole up to 8 characters, plus its bigrams."""
    n = F.length(seg)
    bigrams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: seg.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    whole = F.when(n <= 8, F.array(seg)).otherwise(F.array().cast("array<string>"))
    return F.when(seg.rlike(f"^[{CJK}]"), F.concat(whole, bigrams)).otherwise(F.array(seg))


def tokenize(c: Column, folded: bool = False) -> Column:
    """Lexical terms in order, with repeats. ``folded`` tells that ``c`` is folded already."""
    return F.flatten(F.transform(segments(c if folded else fold(c)), _parts))


def latin_terms(c: Column) -> Column:
    """``tokenize`` for text without CJK, all in the JVM."""
    return F.regexp_extract_all(fold_latin(c), F.lit(r"([a-z0-9]+(?:[._/-][a-z0-9]+)*)"), F.lit(1))


def normalized_version(c: Column) -> Column:
    v = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(v == "", "unknown").otherwise(v)


def cited_ids(c: Column, letter: str = "S") -> Column:
    """Distinct source markers such as [S1], in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"\[({letter}\d+)\]"), F.lit(1)))


def labelled_value(c: Column, labels: tuple[str, ...], stop: str = r"，,。；;\n") -> Column:
    """The text after the first of the labels and an optional colon or copula; null if there is none."""
    v = F.regexp_extract(c, rf"(?iu)(?:{'|'.join(map(re.escape, labels))})(?:\s*(?:是|为|：|:))?\s*([^{stop}]+)", 1)
    v = F.btrim(strip(v), F.lit("：:，,；;。.!！?？\"'“”‘’"))
    return F.when(v != "", v)


def labelled_code(c: Column, labels: tuple[str, ...]) -> Column:
    """An identifier after one of the labels."""
    v = F.regexp_extract(c, rf"(?iu)(?:{'|'.join(map(re.escape, labels))})(?:\s*(?:是|为|：|:))?\s*([A-Za-z0-9][A-Za-z0-9_./-]*)", 1)
    return F.when(v != "", v)


def has_any(c: Column, cues) -> Column:
    """Whether any of the plain cues occurs."""
    return c.rlike("|".join(re.escape(x) for x in cues))


def json_body(c: Column) -> Column:
    """The text inside an optional ```json fence."""
    inner = F.regexp_extract(strip(c), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(strip(c))


def escape_label(c: Column) -> Column:
    """Escapes of a label value in the text exposition format."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def json_map(c: Column) -> Column:
    """map<string,string> of a flat JSON object; an empty map for null, blank or malformed text."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.from_json(strip(c), "map<string,string>"), none)


def sorted_json(values: Column) -> Column:
    """Compact JSON list of an array's values in order."""
    return F.to_json(F.array_sort(values))


def union_sorted(a: Column, b: Column) -> Column:
    """The distinct values of two arrays in order; null counts as none."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def normalized_revision(c: Column) -> Column:
    """A revision's wording with one verb: changed to, set to and the like are all 为."""
    return F.regexp_replace(strip(c), r"(?:修改|更改|调整|变更|改)(?:成|为|到)", "为")


def string_list(c: Column, scalar: bool = False) -> Column:
    """A list of names: a single text is a list of one, null is empty, blanks go."""
    values = F.array(c) if scalar else c
    return F.coalesce(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def stable_digest(**parts: Column) -> Column:
    """SHA-256 of the compact JSON object of the parts, keys sorted, nulls kept."""
    body = F.to_json(F.struct(*[v.alias(k) for k, v in sorted(parts.items())]), {"ignoreNullFields": "false"})
    return F.sha2(body.cast("binary"), 256)
