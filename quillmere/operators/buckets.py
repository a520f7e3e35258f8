"""A keyed table in buckets, where a change rewrites the buckets that it touches and no other.

Rows lie in folders by the hash of their key. A change reads the touched buckets (partition pruning),
puts the new rows in, and overwrites just those folders in one job (dynamic partition overwrite); files
of the others keep their names. A bucket keeps a row without a key, so that one that loses its last
row is overwritten like any other. The numbers of the changes that were applied go into a folder of
their own by the same job, so a change that is played again is left out: exactly once.

One writer at a time; what a crashed job left is overwritten when its change is played again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder
from .index_sync import apply_changes, overlap

BUCKET, BATCH = "__bucket", "__batch"
#: The folder that holds the numbers of applied changes.
LEDGER = -1


def buckets_for(rows: DataFrame, rows_per_bucket: int = 100_000, fewest: int = 8) -> int:
    """A power of two of buckets, so that one holds about ``rows_per_bucket`` rows."""
    n = max(fewest, -(-rows.count() // rows_per_bucket))
    return 1 << (n - 1).bit_length()


class BucketTable:
    """The table below ``path``. ``schema`` is that of its rows; keys are unique and never null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.fields = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        self._there = lambda: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    @classmethod
    def of(cls, rows: DataFrame, key: str = "id", name: str = "table", **how: int) -> BucketTable:
        """A table of ``rows`` in a folder of its own below the shared one."""
        rows = cut(rows)
        made = cls(rows.sparkSession, shared_folder(rows.sparkSession, name), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), key, buckets_for(rows, **how))
        made.apply(rows)
        return made

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.fields)
        if not self._there():
            return self.spark.createDataFrame([], f"{stored}, {BATCH} bigint, {BUCKET} int")
        return self.spark.read.schema(f"{stored}, {BATCH} bigint, {BUCKET} int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().where((F.col(BUCKET) != LEDGER) & F.col(self.key).isNotNull()).select(*[F.col(f"`{f.name}`") for f in self.fields])

    def applied(self) -> list[int]:
        """The numbers in the ledger: the newest ones, as ``apply`` keeps them."""
        return sorted(r[0] for r in self._all().where(F.col(BUCKET) == LEDGER).select(BATCH).collect())

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None, batch: int | None = None, remember: int = 100) -> list[int]:
        """Write and delete rows by key in one step; the buckets that were rewritten. ``deletes`` has the key.

        A key that repeats among the upserts, is null, or is also deleted is an error. A ``batch`` number
        that was applied before, or is older than the ``remember`` newest ones, changes nothing.
        """
        done = self.applied() if batch is not None else []
        if batch is not None and done and (batch in done or batch < done[0]):
            return []
        names = [f.name for f in self.fields]
        upserts = upserts.select(*[F.col(f"`{c}`").cast(f.dataType).alias(c) for c, f in zip(names, self.fields, strict=True)])
        # Both are read several times: checks, touched buckets, the change itself.
        upserts = cut(upserts)
        deletes = upserts.select(self.key).limit(0) if deletes is None else cut(deletes.select(self.key))
        if not upserts.groupBy(self.key).count().where(f"count > 1 or `{self.key}` is null").isEmpty():
            raise ValueError("an id is repeated or missing")
        if not overlap(upserts, deletes, self.key).isEmpty():
            raise ValueError("an id is both written and deleted")
        # No more numbers than there are buckets.
        touched = sorted(r[0] for r in upserts.select(self.key).unionByName(deletes).where(F.col(self.key).isNotNull()).select(self.bucket(F.col(self.key))).distinct().collect())
        if touched:
            have = self._all().where(F.col(BUCKET).isin(touched) & F.col(self.key).isNotNull()).select(*names)
            rows = apply_changes(have, upserts, deletes, self.key).withColumn(BATCH, F.lit(None).cast("bigint")).withColumn(BUCKET, self.bucket(F.col(self.key)))
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields]
            marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int").select(*nothing, F.lit(None).cast("bigint").alias(BATCH), BUCKET)
            parts = [rows, marks]
            if batch is not None:
                kept = [*done, batch][-remember:]
                parts.append(self.spark.createDataFrame([(b,) for b in kept], f"{BATCH} bigint").select(*nothing, BATCH, F.lit(LEDGER).alias(BUCKET)))
            # Stored first, as the buckets that are read are the ones that are overwritten.
            made = cut(reduce(DataFrame.unionByName, parts).repartition(len(touched) + 1, BUCKET))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return touched
