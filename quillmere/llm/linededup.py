"""Line dedup over levelled sorted runs of line keys. DataFrame functions only.

The store is a list of levels; a level holds sorted runs of (128-bit line key, first document).
Runs are tables bucketed and sorted by the key, all with the same number of buckets, so a batch
of documents meets them bucket by bucket: its keys are shuffled once and merge-joined with each
run as it lies on disk. Keys that no run holds become a new run of level 0, and a level with
``fan_in`` runs is merged, again bucket by bucket, to one run of the next level. Batches arrive
in order of document id, so the first holder of a key is its smallest id.

Texts are split twice: once for the line keys, which are stored in the order of the input, and
once to put the lines that stay together. A common line costs one pre-aggregated row for each map
task. Occurrences of keys that hold over a thousandth of all lines meet them by a broadcast of
under a thousand rows, so no task holds all of a common line; the others meet by a merge join.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, aside

TRIM = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a whole text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased (and only those)."""
    k = F.btrim(line, F.lit(TRIM))
    return F.when(F.length(k) == F.octet_length(k), F.lower(k)).otherwise(F.translate(k, UPPER, LOWER))


def occurrences(docs: DataFrame, doc_id: str, text: str, min_length: int) -> DataFrame:
    """d, t (hash of the text), pos, h1, h2 for every line whose key is long enough."""
    lines = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("t"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = lines.select("d", "t", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_length)
    return keyed.select("d", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


@contextmanager
def _merging(spark, buckets: int):
    """Plan with as many shuffle partitions as buckets, and take buckets as sorted as they were written."""
    wanted = {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class LineRuns:
    """Levelled runs of line keys in the shared folder: h1, h2, first; a key is in one run only."""

    def __init__(self, spark, buckets: int, fan_in: int = 2):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.space, self.levels, self._n = Workspace(spark, "lines"), [], 0

    def _store(self, df: DataFrame) -> DataFrame:
        self._n += 1
        return self.space.write_bucketed(df, f"run-{self._n}", self.buckets, "h1", "h2")

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch in; return its keys that are repeated: h1, h2, first (the document that keeps them) and
        n, how often the batch has them."""
        with _merging(self.spark, self.buckets):
            merged = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
            runs = [run for level in self.levels for run in level]
            for i, run in enumerate(runs):
                merged = merged.join(run.withColumnRenamed("first", f"run{i}").hint("merge"), ["h1", "h2"], "left")
            before = F.coalesce(*[F.col(f"run{i}") for i in range(len(runs))], F.lit(None).cast(lines.schema["d"].dataType))
            table = self._store(merged.select("h1", "h2", F.coalesce(before, "first").alias("first"), "last", "n", before.isNotNull().alias("seen")))
            self._push(0, table.where(~F.col("seen")).select("h1", "h2", "first"))
        return table.where(F.col("seen") | (F.col("first") < F.col("last"))).select("h1", "h2", "first", "n")

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._store(reduce(_merged, runs)))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs without a common key, merged in order of the key."""
    both = a.join(b.withColumnRenamed("first", "other").hint("merge"), ["h1", "h2"], "full_outer")
    return both.select("h1", "h2", F.coalesce("first", "other").alias("first"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 10, batches: int = 4, fan_in: int = 2, buckets: int | None = None, bucket_lines: int = 4_000_000) -> DataFrame:
    """All columns of ``docs``, with n_lines, n_dropped and kept (the text that stays).

    A key of at least ``min_length`` code points that several documents hold loses its lines in
    all but the smallest id. Rows of one id are one document; a row with a null id is left as
    it is and counts for nothing. A null text is one empty line, and is kept as an empty text. A
    very long text is split like any other; an empty table gives none. An input column named
    n_lines, n_dropped or kept is replaced.
    """
    spark = docs.sparkSession
    docs, own = aside(docs, doc_id, text)
    store = LineRuns(spark, 1, fan_in)
    cuts = docs.agg(F.percentile_approx(doc_id, F.array(*[F.lit(i / batches) for i in range(1, batches)]), F.lit(1000)).alias("c")).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.when(F.col("d") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    lines = store.space.write(occurrences(docs, doc_id, text, min_length).withColumn("batch", batch.cast("int")), "occurrences", partition_by="batch")
    n_lines = lines.count()
    # As many buckets as keep one to bucket_lines lines, so that a bucket's sort stays the same size at any scale.
    store.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // bucket_lines))
    repeated = reduce(DataFrame.unionAll, [store.add(lines.where(F.col("batch") == i)) for i in range(len(cuts) + 1)])
    repeated = store.space.write(repeated.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "repeated")
    # Keys of over a thousandth of the lines, of which there are under a thousand, are broadcast; the others meet by merge.
    frequent = F.col("n") * 1000 > F.lit(n_lines)
    common, rare = (repeated.where(c).select("h1", "h2", "first") for c in (frequent, ~frequent))
    apart = lines.join(F.broadcast(common.select("h1", "h2")), ["h1", "h2"], "left_anti")
    drops = lines.join(F.broadcast(common), ["h1", "h2"]).unionByName(apart.join(rare.hint("merge"), ["h1", "h2"])).where("d > first")
    per_doc = drops.groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("__drop"))
    per_doc = per_doc.select(F.col("d").alias("__d"), F.col("t").alias("__t"), "__drop")
    joined = docs.join(per_doc.hint("merge"), (F.col(doc_id) == F.col("__d")) & (F.xxhash64(F.col(text)) == F.col("__t")), "left")
    lined = joined.withColumn("__lines", lines_of(F.col(text))).withColumn("n_lines", F.size("__lines").cast("bigint")).withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint"))
    # Slices between dropped positions, so that the cost is linear in the number of lines.
    begins = F.concat(F.array(F.lit(-1)), F.col("__drop"))
    ends = F.concat(F.col("__drop"), F.array(F.size("__lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(F.col("__lines"), a + 2, b - a - 1)))
    keep = F.when(F.col("__drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return lined.withColumn("kept", keep).select(*[F.col(n).alias(c) for c, n in own.items() if c not in ("n_lines", "n_dropped", "kept")], "n_lines", "n_dropped", "kept")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), f AS (
  SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL AND doc_id > first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL OR doc_id <= first), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
