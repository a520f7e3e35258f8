"""Sources: documents (Markdown, DOCX, plug-ins), JSON Lines datasets, tables; sinks for reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from ..operators.safety import redact

SCHEMA = "path string, stem string, loader string, text string, line_blocks array<int>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """UTF-8 .md files of one folder, a byte-order mark tolerated; one row for each file."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return _named(raw).select("path", "stem", F.lit("markdown").alias("loader"), "text", F.lit(None).cast("array<int>").alias("line_blocks"), F.when(strip(F.col("text")) == "", "empty").alias("error"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def render_table(rows: list[list[str]]) -> list[str]:
    """A table as pipe lines: padded to the widest row, pipes escaped, a rule under the first row."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return []
    cells = [[" ".join(c.split()).replace("|", r"\|") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return [lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]


def docx_text(content: bytes) -> tuple[str, list[int]]:
    """Lines of a .docx in order, with the block each comes from; Heading n becomes n hash signs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines: list[str] = []
    blocks: list[int] = []

    def words(p) -> str:
        return "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()

    for n, block in enumerate(list(body) if body is not None else [], 1):
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = name.lower().removeprefix("heading").strip()
            mark = "#" * int(level) + " " if name.lower().startswith("heading") and level.isdigit() else ""
            new = [mark + words(block)] if words(block) else []
        elif block.tag == f"{_W}tbl":
            new = render_table([[words(c) for c in r.findall(f"{_W}tc")] for r in block.findall(f"{_W}tr")])
        else:
            new = []
        lines += new
        blocks += [n] * len(new)
    return "\n".join(lines), blocks


def parsed(spark: SparkSession, folder: str, suffix: str, loader: str, parse: Callable[[bytes], tuple[str, list[int]]]) -> DataFrame:
    """Binary files of one suffix through a parser; a file that fails is a row with its error."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text, blocks = parse(bytes(content))
                    error = None if text.strip() else "empty"
                except Exception as e:  # noqa: BLE001  any parser failure belongs to its file
                    text, blocks, error = None, None, type(e).__name__
                rows.append((path, None, loader, text, blocks, error))
            yield pd.DataFrame(rows, columns=["path", "stem", "loader", "text", "line_blocks", "error"])

    return _named(raw.mapInPandas(run, SCHEMA)).select(*[c.split()[0] for c in SCHEMA.split(", ")])


class Registry:
    """Suffix -> loader. A suffix may be registered once; PDF and image parsers plug in here."""

    def __init__(self):
        self._by: dict[str, tuple[str, Callable | None]] = {}
        self.register(".md", "markdown", None)
        self.register(".docx", "docx", docx_text)

    def register(self, suffix: str, name: str, parse: Callable[[bytes], tuple[str, list[int]]] | None) -> None:
        suffix = suffix.lower()
        if not suffix.startswith("."):
            raise ValueError("a suffix begins with a dot")
        if suffix in self._by:
            raise ValueError(f"{suffix} has a loader")
        self._by[suffix] = (name, parse)

    def load(self, spark: SparkSession, folder: str) -> DataFrame:
        """All supported files of one folder (not below it), with their place by name."""
        out = None
        for suffix, (name, parse) in self._by.items():
            part = markdown(spark, folder) if parse is None else parsed(spark, folder, suffix, name, parse)
            out = part if out is None else out.unionByName(part)
        return out

    def discover(self, spark: SparkSession, folder: str) -> DataFrame:
        """path, suffix of the supported files of one folder, in order of their names."""
        names = spark.read.format("binaryFile").load(folder).select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))
        return names.where(F.col("suffix").isin(*self._by)).orderBy(F.regexp_extract("path", r"([^/]+)$", 1))


def sidecars(spark: SparkSession, folder: str, suffix: str = ".metadata.yaml") -> DataFrame:
    """Trusted metadata files beside documents: stem, header, header_error (empty, or null)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "^\ufeff", "").alias("header"))
    stem = F.regexp_replace("name", re.escape(suffix) + "$", "")
    return raw.select(F.regexp_replace(stem, "%20", " ").alias("stem"), strip(F.col("header")).alias("header"), F.when(strip(F.col("header")) == "", "empty").alias("header_error"))


def with_sidecars(documents: DataFrame, sidecars: DataFrame, needed: tuple[str, ...] = ("docx", "pdf")) -> DataFrame:
    """Join trusted metadata files (stem, header) to documents by stem. A document of a loader that needs
    one and has none, or an empty one, gets the error missing_metadata."""
    d = documents.join(sidecars.select("stem", "header"), "stem", "left")
    if not {"loader", "error"} <= set(d.columns):
        return d
    lacks = F.col("loader").isin(*needed) & (F.coalesce(F.col("header"), F.lit("")) == "")
    return d.withColumn("error", F.coalesce("error", F.when(lacks, "missing_metadata")))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words (doc, page, block, par, line, n, text, conf) -> lines with mean confidence of words that have one."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return words.where(strip(F.col("text")) != "").groupBy("doc", "page", "block", "par", "line").agg(text.alias("text"), (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"))


def ocr_gate(pages: DataFrame, least_characters: int = 20, least_confidence: float = 0.8) -> DataFrame:
    """``pages`` (text, confidence) with rejected: too_short, low_confidence or null."""
    n = F.length(F.regexp_replace("text", r"\s", ""))
    return pages.withColumn("rejected", F.when(n < least_characters, "too_short").when(F.coalesce("confidence", F.lit(0.0)) < least_confidence, "low_confidence"))


class NoOcr:
    """The provider that recognises nothing: where no OCR engine is installed."""

    name = "none"

    def __call__(self, image: bytes) -> list[tuple[str, float]]:
        raise RuntimeError("no OCR engine")


def recognised(images: DataFrame, provider: Callable[[bytes], list[tuple[str, float]]] | None = None, most_bytes: int = 20 << 20) -> DataFrame:
    """doc, unit, text, confidence, error of images (doc, unit, content). ``provider`` gives the words of an
    image with their confidence from 0 to 1; an image that is too large or fails is a row with its error."""
    recognise = provider or NoOcr()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, unit, content in zip(pdf["doc"], pdf["unit"], pdf["content"], strict=True):
                words, error = [], None
                if content is None or len(content) > most_bytes:
                    error = "too_large" if content is not None else "empty"
                else:
                    try:
                        words = recognise(bytes(content))
                    except Exception as e:  # noqa: BLE001  any failure belongs to its image
                        error = type(e).__name__
                known = [c for _, c in words if c is not None and 0 <= c <= 1]
                rows.append((doc, unit, " ".join(t for t, _ in words if t.strip()) or None, sum(known) / len(known) if known else None, error))
            yield pd.DataFrame(rows, columns=["doc", "unit", "text", "confidence", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    return images.select("doc", "unit", "content").mapInPandas(run, f"doc {kinds['doc']}, unit {kinds['unit']}, text string, confidence double, error string")


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a JSON Lines dataset: problems are malformed lines and repeated keys. Rows have
    line_no, their place in their file; blank lines count but are no rows."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r\n|\r|\n")).alias("n", "line")).where(strip(F.col("line")) != "")
    parsed = lines.select((F.col("n") + 1).alias("line_no"), "line", F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    broken = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    bad = parsed.where(broken).select(F.lit("malformed").alias("problem"), F.col("line").alias("detail"), "line_no")
    rows = parsed.where(~broken).select("line_no", "r.*").drop("_corrupt_record")
    again = rows.groupBy(key).agg(F.sort_array(F.collect_list("line_no")).alias("at")).where(F.size("at") > 1)
    twice = again.select(F.lit("repeated").alias("problem"), F.col(key).cast("string").alias("detail"), F.col("at")[1].alias("line_no"))
    return rows, bad.unionByName(twice)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of the bytes of each file, to tell which dataset a result is of."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def empty_web_results(spark: SparkSession) -> DataFrame:
    """The provider that is never available."""
    return spark.createDataFrame([], "query_id bigint, url string, title string, snippet string, position int")


def web_results(raw: DataFrame, max_results: int = 5) -> DataFrame:
    """Search results: one row for each URL (the first), texts collapsed, without secrets and cut, at most max_results."""
    if not 1 <= max_results <= 5:
        raise ValueError("one to five results")
    clean = lambda c, n: F.substring(F.coalesce(redact(collapse(F.col(c)), 1 << 20)["content"], F.lit("")), 1, n).alias(c)
    w = Window.partitionBy("query_id", "url").orderBy("position")
    once = raw.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "url"))).where(F.col("place") <= max_results)
    return ranked.select("query_id", "url", clean("title", 200), clean("snippet", 600), F.col("place").alias("position"))


def write_report(report: DataFrame, folder: str) -> None:
    """A report as one JSON line for each row; the folder appears only when it is complete."""
    report.write.mode("overwrite").json(folder)


def markdown_report(report: DataFrame, title: str, order: str) -> DataFrame:
    """A bounded report as one Markdown text: a title and a table in order of a column."""
    cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in report.columns]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "| " + " | ".join("---" for _ in report.columns) + " |"]
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return report.agg(F.array_join(F.concat(F.array(*[F.lit(h) for h in head]), lines), "\n").alias("markdown"))


def jdbc_table(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a relational store, if its driver is on the class path. ``partition`` is (column,
    lower bound, upper bound, number of partitions) for a parallel read."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if partition:
        for key, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition, strict=True):
            r = r.option(key, str(value))
    return r.load()
