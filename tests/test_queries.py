"""Every query with an oracle equals DuckDB on the smallest tables; the entry query runs."""

import os

import pytest

from quillmere import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(rows, columns):
    value = lambda v: round(float(v), 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([str(value(r[i])) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    got = canonical(df.collect(), df.columns)
    c = duck.execute(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(x[0] for x in c.description)
    assert got == canonical(c.fetchall(), [x[0] for x in c.description])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"] and df.count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
