"""Service tables as catalogue entries: DDL that may run again, with a version that later code refuses.

The tables are declared once, as columns and how they are bucketed by the key that they are looked up by.
Each carries the version of its layout as a table property: creating it again changes nothing, a table of
an older version gains the columns that were added since, and one of a newer version is left alone with
an error, before anything is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Version of the layout below.
VERSION = 2
PROPERTY = "quillmere.version"


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the columns that a row is looked up by, and what was added in which version."""

    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    added: tuple[tuple[str, int], ...] = ()
    buckets: int = 16


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((c.split(" ", 1)[0], c.split(" ", 1)[1]) for c in text.split(", "))


TABLES = (
    Table("sessions", _columns("session_id string, owner string, phase string, revision bigint, updated_at timestamp, expires_at timestamp"), ("session_id",), (("expires_at", 2),)),
    Table("messages", _columns("session_id string, turn bigint, role string, content string, message_id string, created_at timestamp"), ("session_id",)),
    Table("drafts", (*_columns("draft_id string, revision bigint, session_id string, application_type string, status string, idempotency_key string"), ("fields", "map<string, string>")), ("draft_id",)),
    Table("submissions", _columns("idempotency_key string, draft_id string, owner string, session_id string, outcome string, at timestamp"), ("idempotency_key",)),
    Table("checkpoints", _columns("thread_id string, namespace string, checkpoint_id string, parent_id string, state binary, metadata string"), ("thread_id",)),
    Table("checkpoint_writes", _columns("thread_id string, checkpoint_id string, task_id string, position int, channel string, value binary"), ("thread_id",)),
    Table("index_entries", _columns("id string, document_id string, fingerprint string, metadata string"), ("id",)),
    Table("audit_events", _columns("event_id string, session_id string, action string, outcome string, at timestamp"), ("session_id",)),
)


def version_of(spark: SparkSession, table: str) -> int | None:
    """The version that a table carries; 0 for one without, null for none."""
    if not spark.catalog.tableExists(table):
        return None
    held = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return int(held.get(PROPERTY, 0))


def create(spark: SparkSession, database: str = "quillmere", tables: tuple[Table, ...] = TABLES, version: int = VERSION) -> list[str]:
    """Create or bring up to ``version`` the tables of a database; the names of those that changed. A table of a
    later version is an error, and then none is touched."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    have = {t.name: version_of(spark, f"{database}.{t.name}") for t in tables}
    if later := sorted(n for n, v in have.items() if v is not None and v > version):
        raise ValueError(f"of a later version than {version}: {', '.join(later)}")
    changed = []
    for t in tables:
        name, held = f"{database}.{t.name}", have[t.name]
        if held is None:
            body = ", ".join(f"`{c}` {kind}" for c, kind in t.columns)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING parquet CLUSTERED BY ({', '.join(t.key)}) INTO {t.buckets} BUCKETS TBLPROPERTIES ('{PROPERTY}' = '{version}')")
        elif held < version:
            kinds, there = dict(t.columns), set(spark.table(name).columns)
            for column, since in t.added:
                if since > held and column not in there:
                    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`{column}` {kinds[column]})")
            spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PROPERTY}' = '{version}')")
        else:
            continue
        changed.append(t.name)
    return changed
