"""Written tables that cut a plan in the folder which every executor shares.

Intermediate results that are read more than once, or that end an iteration,
go to ``spark.checkpoint.dir`` as Parquet. A lost executor then costs a re-read,
not a recomputation, and nothing depends on a machine's own disk.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DIR = "/tmp/quillmere-shared"


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a folder of this machine in local
    mode, and an error on a cluster, whose executors couldn't read each other's tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or LOCAL_DIR


class Workspace:
    """A private folder under the shared root; removed when the JVM ends, or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/quillmere-{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, partition_by: str | None = None, **options: str) -> DataFrame:
        """Write ``df`` and return the table as read back, with no lineage behind it."""
        writer = df.write.mode("overwrite").option("compression", "zstd").options(**options)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(table))
        schema = df.schema
        del df
        return self.spark.read.schema(schema).parquet(self.path(table))

    def write_bucketed(self, df: DataFrame, table: str, buckets: int, *keys: str) -> DataFrame:
        """Write ``df`` in buckets of ``keys``, sorted by them. The table's name goes with this session."""
        name = f"quillmere_{self.root.rsplit('-', 1)[-1]}_{table.replace('-', '_')}"
        df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", self.path(table)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, table: str) -> None:
        self._fs.delete(self._path(self.path(table)), True)

    def release(self) -> None:
        """Let the cleaner remove shuffle files of plans nobody refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def aside(docs: DataFrame, *keep: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns, but for ``keep``, under names that no operator makes, and the name that each
    column has now. An operator's own columns then clash with none of its input, whatever those are called."""
    names = {c: c if c in keep else f"__own_{i}__" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def block_count(df: DataFrame, text: str, block_bytes: int) -> int:
    """Blocks for packed exchanges, so that a block fits a task whatever the shuffle parallelism is:
    by the bytes of the texts."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // block_bytes))
