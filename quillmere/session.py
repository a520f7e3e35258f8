"""Session settings and table readers shared by the library's queries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine expects; sizes and parallelism stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: For tables whose rows are megabytes: a row group holds 16 MB, and its writer looks after every row, not after a
#: hundred as by default, so that writing and reading hold a few rows whatever a task has.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Limits:
    """Bounds of a service's requests; a value out of range is an error when it is set."""

    top_k: int = 5
    candidate_k: int = 20
    max_context_chunks: int = 5
    memory_turns: int = 50
    context_characters: int = 2400
    queue_timeout_seconds: float = 2.0
    cache_ttl_seconds: int = 3600

    def __post_init__(self):
        ranges = {"top_k": (1, 20), "candidate_k": (1, 1000), "max_context_chunks": (1, 20), "memory_turns": (1, 1000), "context_characters": (1, 1_000_000), "queue_timeout_seconds": (0.001, 600), "cache_ttl_seconds": (1, 30 * 86_400)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} is from {low} to {high}")
        if self.candidate_k < self.top_k:
            raise ValueError("candidate_k is at least top_k")


def _shared(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/quillmere-shared").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and stored in the shared folder, with no lineage behind it. The folder is
    ``spark.checkpoint.dir``; only a local session gets one of its own where that is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; what is written there goes when the session's JVM ends."""
    path = f"{_shared(spark)}/quillmere-{name}-{uuid.uuid4().hex[:12]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to a folder of its own below the shared one, and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand their Python tasks at most ``rows`` rows and 64 MB at a time. The default is
    10,000 rows, for large rows all that a task has."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def build_session(name: str = "quillmere", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
