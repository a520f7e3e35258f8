"""Incremental index synchronisation: fingerprints, diff, apply, report, versioned table store."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

STATUSES = ("added", "changed", "unchanged", "deleted")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of a JSON object of the parts in the given order; null parts are left out."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def record_metadata(fields: dict[str, Column]) -> Column:
    """map<string,string> of the fields that have a value; the others are absent."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(fields.items())])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def diff(desired: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """key, status by full outer join of (key, fingerprint). Fingerprints compare null-safely."""
    d = desired.select(key, F.col("fingerprint").alias("new"), F.lit(True).alias("in_new"))
    c = current.select(key, F.col("fingerprint").alias("old"), F.lit(True).alias("in_old"))
    j = d.join(c, key, "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return j.select(key, status.alias("status"))


def stale(desired: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    return current.select(key).join(desired.select(key), key, "left_anti")


def report(statuses: DataFrame) -> DataFrame:
    """Counts of every status, also of those without rows."""
    seed = statuses.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("status"))
    return seed.join(statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def apply_changes(current: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """The table after the change: old rows that are neither replaced nor deleted, plus the upserts."""
    touched = upserts.select(key).unionByName(deletes.select(key)).distinct()
    return current.join(touched, key, "left_anti").unionByName(upserts)


def overlap(upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Ids both upserted and deleted; must be empty before a change is applied."""
    return upserts.select(key).join(deletes.select(key), key, "left_semi").distinct()


def digest_of(rows: DataFrame, key: str, value: str, *groups: str) -> DataFrame:
    """SHA-256 over the sorted ``key:value`` lines of each group. A group is one document's chunks."""
    line = F.concat_ws(":", F.col(key).cast("string"), F.col(value))
    return rows.groupBy(*groups).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def corpus_digest(rows: DataFrame, key: str, value: str, cell_rows: int = 4096, levels: int | None = None) -> DataFrame:
    """One digest of a whole table, independent of order: a tree of SHA-256 over ranges of hashed lines.

    A line's hash puts it into a range of its first bits; the number of ranges grows with the table,
    level by level, so that no task sees more than a range of about ``cell_rows`` lines, and a
    node's digest is that of its sorted children. The depth is a function of the number of rows, or
    ``levels`` where digests of tables of any size follow one form.
    """
    line = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(value)), 256)
    depth, n = levels or 0, 0 if levels is not None else rows.count()
    while n > cell_rows * 256**depth:
        depth += 1
    level = rows.select(F.substring(line, 1, 2 * depth).alias("range"), line.alias("l"))
    for d in range(depth, -1, -1):
        level = level.groupBy("range").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("l"))
        if d:
            level = level.select(F.substring("range", 1, 2 * (d - 1)).alias("range"), F.concat("range", F.lit(":"), "l").alias("l"))
    empty = rows.sparkSession.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("e"))
    return empty.join(level.select("l"), how="left").select(F.coalesce("l", "e").alias("digest"))


def manifest_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 of the ``key:value`` lines of a bounded set, such as the chunks of an evaluation corpus, sorted by key."""
    one = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.concat_ws(":", F.col(key).cast("string"), F.col(value)).alias("line"))))
    return rows.agg(F.sha2(F.array_join(F.transform(one, lambda x: x["line"]), "\n"), 256).alias("digest"))


def document_report(desired: DataFrame, current: DataFrame, key: str = "id", document: str = "document_id") -> DataFrame:
    """document, status, chunk_count, upserted, deleted of every document of both sides.

    Both sides have key, document and fingerprint. A document is added, deleted, unchanged (the same
    chunks with the same fingerprints) or updated. ``upserted`` counts its new and changed chunks, and
    ``deleted`` its chunks that no document wants any more. A current chunk without a document is one
    of its own.
    """
    orphan = F.concat(F.lit("__orphan__:"), F.col(key).cast("string"))
    c = current.select(key, F.coalesce(F.nullif(F.col(document).cast("string"), F.lit("")), orphan).alias("old_doc"), F.col("fingerprint").alias("old"), F.lit(True).alias("in_old"))
    d = desired.select(key, F.col(document).cast("string").alias("new_doc"), F.col("fingerprint").alias("new"), F.lit(True).alias("in_new"))
    j = d.join(c, key, "full_outer")
    same = F.col("in_new").isNotNull() & F.col("in_old").isNotNull() & F.col("old").eqNullSafe(F.col("new"))
    j = j.withColumn("same", same).withColumn("moved", F.col("in_new").isNotNull() & F.col("in_old").isNotNull() & (F.col("old_doc") != F.col("new_doc")))
    wanted = j.where("in_new").select(F.col("new_doc").alias(document), F.lit(1).alias("want"), F.col("moved").cast("int").alias("here"), F.lit(0).alias("had"), (~F.col("same")).cast("int").alias("up"), F.lit(0).alias("down"))
    held = j.where("in_old").select(F.col("old_doc").alias(document), F.lit(0).alias("want"), F.col("moved").cast("int").alias("here"), F.lit(1).alias("had"), F.lit(0).alias("up"), F.col("in_new").isNull().cast("int").alias("down"))
    g = wanted.unionAll(held).groupBy(document).agg(*[F.sum(x).alias(x) for x in ("want", "here", "had", "up", "down")])
    status = F.when(F.col("want") == 0, "deleted").when(F.col("had") == 0, "added").when((F.col("up") == 0) & (F.col("down") == 0) & (F.col("here") == 0), "unchanged").otherwise("updated")
    return g.select(document, status.alias("status"), F.col("want").alias("chunk_count"), F.col("up").alias("upserted"), F.when(F.col("want") == 0, F.col("had")).otherwise(F.col("down")).alias("deleted"))


def synchronise(store: TableStore, desired: DataFrame, embed: Callable[[DataFrame], DataFrame], document: str = "document_id") -> DataFrame:
    """Bring a stored index to ``desired`` (key, document, fingerprint, text): only changed rows are
    embedded, stale ones go in the same step. Returns the report by document of what was done."""
    key, have = store.key, store.read()
    if desired.isEmpty():
        raise ValueError("refusing to clear the index")
    _unique(desired, key)
    current = desired.select(key, document, "fingerprint").limit(0) if have is None else have.select(key, document, "fingerprint")
    changes = diff(desired, current, key)
    report = cut(document_report(desired, current, key, document))
    changed = desired.join(changes.where("status in ('added', 'changed')"), key, "left_semi")
    store.apply(embed(changed), changes.where("status = 'deleted'").select(key))
    return report


def _unique(rows: DataFrame, key: str) -> None:
    if not rows.groupBy(key).count().where(f"count > 1 or `{key}` is null").isEmpty():
        raise ValueError("an id is repeated or missing")


#: Layout of a store's folder; a store of a later one is not touched.
FORMAT = 2


class TableStore:
    """A keyed table in versioned folders; readers see one whole version.

    A change is checked, written as a folder of its own, and becomes current by a commit file that is
    renamed to the next number. A rename never replaces a file: of two writers one fails, and a crash
    leaves the last commit as it was. Older versions stay for their readers until ``vacuum``.
    ``schema``, if given, is what the table must have.
    """

    def __init__(self, spark, root: str, key: str = "id", schema: str | None = None):
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        p = self._path(f"{self.root}/_commits")
        if not self._fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(p) if f.getPath().getName().isdigit())

    def _commit(self, number: int) -> dict:
        c = json.loads(self.spark.read.text(f"{self.root}/_commits/{number:020d}", wholetext=True).first()[0])
        if c["format"] != FORMAT:
            raise ValueError(f"a store of format {c['format']}; this is {FORMAT}")
        return c

    def version(self) -> str | None:
        done = self._commits()
        return self._commit(done[-1])["version"] if done else None

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.root}/{v}")

    def _publish(self, df: DataFrame, after: int) -> str:
        if self.schema is not None:
            want = [(f.name, f.dataType) for f in self.spark.createDataFrame([], self.schema).schema]
            if want != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError("the rows don't have the store's schema")
        name, temporary = f"v-{uuid.uuid4().hex}", self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        df.write.parquet(f"{self.root}/{name}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"format": FORMAT, "version": name}).encode()))
        out.close()
        # Some file systems would replace the target of a rename.
        target = self._path(f"{self.root}/_commits/{after + 1:020d}")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            raise RuntimeError("another writer was first")
        return name

    def _last(self) -> int:
        return max(self._commits(), default=0)

    def add(self, rows: DataFrame) -> str:
        """Insert only: an id that exists, or one that repeats, is an error and nothing changes."""
        after, have = self._last(), self.read()
        _unique(rows, self.key)
        if have is not None and not have.join(rows.select(self.key), self.key, "left_semi").isEmpty():
            raise ValueError("an id exists")
        return self._publish(rows if have is None else have.unionByName(rows), after)

    def apply(self, upserts: DataFrame, deletes: DataFrame | None = None) -> str:
        """Write and delete in one step. An id that repeats among the upserts, or is also deleted, is an error."""
        after, have = self._last(), self.read()
        deletes = upserts.select(self.key).limit(0) if deletes is None else deletes
        _unique(upserts, self.key)
        if not overlap(upserts, deletes, self.key).isEmpty():
            raise ValueError("an id is both written and deleted")
        return self._publish(upserts if have is None else apply_changes(have, upserts, deletes, self.key), after)

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the ``keep`` newest versions; readers of older ones must have ended."""
        done = self._commits()
        for number in done[: max(0, len(done) - max(keep, 1))]:
            name = self._commit(number)["version"]
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
            self._fs.delete(self._path(f"{self.root}/_commits/{number:020d}"), False)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)


class Collections:
    """Named stores below one root; dropping one leaves the others."""

    def __init__(self, spark, root: str, key: str = "id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def store(self, name: str, schema: str | None = None) -> TableStore:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", name):
            raise ValueError("a collection's name is letters, digits, - and _")
        return TableStore(self.spark, f"{self.root}/{name}", self.key, schema)

    def names(self) -> list[str]:
        s = TableStore(self.spark, self.root)
        p = s._path(self.root)
        return sorted(f.getPath().getName() for f in s._fs.listStatus(p) if f.isDirectory()) if s._fs.exists(p) else []

    def drop(self, name: str) -> None:
        self.store(name).drop()
