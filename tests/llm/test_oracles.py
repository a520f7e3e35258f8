"""Every query of the subpackage that SQL can express equals DuckDB on the smallest tables."""

import os

import pytest

from quillmere.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    c = duck.execute(registry.oracle_sql()[name])
    columns = sorted(x[0] for x in c.description)
    assert sorted(df.columns) == columns
    place = [[x[0] for x in c.description].index(k) for k in columns]
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([value(r[i]) for i in place]) for r in c.fetchall())
    assert sorted(repr([value(r[k]) for k in columns]) for r in df.collect()) == want
