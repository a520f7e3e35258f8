"""Queries of any length: none is left out for its number of terms, and long ones are answered exactly."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmere import plans
from quillmere.operators import lexical, postings
from quillmere.plans.retrieval import six

from test_queries import SF, canonical, pytestmark  # noqa: F401


@pytest.fixture(scope="module")
def long_items(tmp_path_factory):
    """The smallest tables with items of 64, 65, 1,500 and more distinct terms beside those of the benchmark."""
    folder = tmp_path_factory.mktemp("long")
    docs = pq.read_table(f"{SF}/documents.parquet")
    items = pq.read_table(f"{SF}/benchmark.parquet")
    words = sorted({w for t in docs["text"].to_pylist() for w in t.lower().split() if w.isascii() and w.isalnum()})
    longest = sorted(docs["text"].to_pylist(), key=len)[-3:]
    texts = [" ".join(words[:64]), " ".join(words[:65]), " ".join(words[:64] * 2), " ".join(words[::-1]), *longest, " ".join(f"nowhere{i}" for i in range(70)), "?! " * 70]
    more = pa.table({"item_id": pa.array(range(5000, 5000 + len(texts)), items["item_id"].type), "text": pa.array(texts, items["text"].type)})
    pq.write_table(pa.concat_tables([items.select(["item_id", "text"]), more]), folder / "benchmark.parquet")
    os.symlink(f"{SF}/documents.parquet", folder / "documents.parquet")
    return str(folder), len(words)


@pytest.mark.parametrize("name", ["bm25_multi_query", "bm25_topk"])
def test_items_of_any_length_are_answered(spark, long_items, name):
    duckdb = pytest.importorskip("duckdb")
    folder, n_words = long_items
    assert n_words > 1500
    df = plans.queries()[name](spark, folder)
    rows = df.collect()
    assert {r.query_id for r in rows if r.query_id >= 5000} == {5000, 5001, 5002, 5003, 5004, 5005, 5006}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    c = con.execute(plans.oracle_sql()[name])
    assert canonical(rows, df.columns) == canonical(c.fetchall(), [x[0] for x in c.description])


def test_other_queries_keep_the_limit_of_their_sql():
    kept = {n for n, s in plans.oracle_sql().items() if "len(terms) BETWEEN 1 AND 64" in s}
    assert {"rrf_fuse", "hybrid_topk", "rerank_overlap", "guarded_answers", "scoped_channels", "reranked_answers"} <= kept


def test_blocks_of_queries_are_bounded_by_their_terms(spark):
    """Few long queries make a block, one that is longer than a block is one of its own; the answers are the same."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.col("id") % 40 + 5), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id") * F.col("id")) % 500)).alias("terms"))
    asked = spark.range(9).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 4, 400).otherwise(F.col("id") * 30 + 1)), lambda i: F.concat(F.lit("w"), (i + F.col("id")) % 500))).alias("text"))
    queries = lexical.query_terms(asked, F.split("text", " "), limit=None)
    sizes = {r.query_id: r["count"] for r in queries.groupBy("query_id").count().collect()}
    assert len(sizes) == 9 and sizes[4] == 400 and sizes[8] == 241
    t = lexical.tokens(docs, F.col("terms"))
    want = sorted(map(str, lexical.top_k(lexical.scores(t, queries), 5).select("query_id", "doc_id", "score", "rank").collect()))
    index = postings.Postings(t, shard_docs=70)
    seen, frequencies = [], index.frequencies
    index.frequencies = lambda words: seen.append(len(words)) or frequencies(words)
    got = lexical.top_k(index.search(queries, 5, block_terms=250), 5).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(str, got.collect())) == want and len(want) == 45
    assert len(seen) > 4 and max(seen) == 400 and sorted(seen)[-2] <= 250
    seen.clear()
    few = lexical.top_k(index.search(queries, 5, query_block=2), 5).select("query_id", "doc_id", "score", "rank")
    assert sorted(map(str, few.collect())) == want and len(seen) == 5


def test_pieces_of_postings(monkeypatch):
    """A long query is scored in pieces of bounded size, with the same candidates."""
    r = np.random.default_rng(3)
    docs = [[f"t{x}" for x in r.zipf(1.3, size=n) if x < 5000] for n in r.integers(1, 400, 700)]
    lengths = np.array([len(d) for d in docs])
    made = postings._inverted(np.arange(700), lengths, pa.array(docs, pa.list_(pa.string())))
    words = pa.array(sorted({t for d in docs for t in d}))
    shard = postings._Shard(made, words, float(lengths.mean()), 1.2, 0.75)
    ask = lambda k: shard.best(np.arange(len(words)), np.linspace(0.1, 5, len(words)), k, 0.0, 9)[:2]
    best = lambda k: sorted(zip(*(x.tolist() for x in ask(k)), strict=True), key=lambda p: (-p[1], p[0]))[:k]
    whole = {k: best(k) for k in (1, 10, 700)}
    assert len(words) > 500 and len(whole[700]) == sum(n > 0 for n in lengths)
    monkeypatch.setattr(postings, "POSTINGS", 3)
    taken, inner = [], postings._Shard.part
    monkeypatch.setattr(postings._Shard, "part", lambda self, tf, dl: taken.append(len(tf)) or inner(self, tf, dl))
    assert {k: best(k) for k in whole} == whole
    pairs = sum(len(set(d)) for d in docs)
    assert max(n for n in taken[1:]) < 0.3 * pairs


def test_rounding_of_a_long_query_loses_no_document():
    """The bound of a range may lie below a sum of the same terms by more than the fixed slack."""
    n = 200_000
    shard = object.__new__(postings._Shard)
    lists = np.arange(n)
    shard.place, shard.blocks, shard.ranges = lists, np.arange(n + 1), np.zeros(n, np.int32)
    shard.begins, shard.most_tf, shard.least_dl = np.arange(n + 1), np.ones(n, np.int32), np.ones(n, np.int64)
    shard.local, shard.tf, shard.lengths, shard.ids = np.zeros(n, np.int32), np.ones(n, np.int32), np.array([1]), np.array([7])
    shard.k1, shard.b, shard.mean = 1.2, 0.75, 1.0
    weight = np.random.default_rng(1).random(n) * 12
    score = shard.best(lists, weight, 1, 0.0, 9)[1][0]
    floor = score + 5e-9  # as another order of summation would have it
    assert shard.best(lists, weight, 1, floor - 1e-8, 9)[0].tolist() == [7]
    assert shard.best(lists, weight, 1, floor, 9)[2] == n  # looked at, since its bound can't rule it out


def test_scores_are_rounded_as_by_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(5)
    scores = [131.1361595, 0.0000005, 0.000001, 12345.0000005] + (np.round(r.random(5000) * 10.0 ** r.integers(-2, 5, 5000), 6) + 5e-7).round(9).tolist()
    want = [x for (x,) in duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [scores]).fetchall()]
    rows = spark.createDataFrame(list(enumerate(scores)), "i int, s double").select("i", six(F.col("s")).alias("s"), F.round("s", 6).alias("other")).orderBy("i").collect()
    assert [x.s for x in rows] == want and want[0] == 131.136159
    assert [x.other for x in rows] != want


def test_a_writer_of_shards_keeps_none_of_their_columns(spark):
    """Statistics would hold the least and the greatest value of each row group, megabytes each, until a file ends."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.md5(F.concat_ws(":", F.col("id"), i)))
    docs = spark.range(0, 2400, 1, 1).select(F.col("id").alias("doc_id"), terms.alias("terms"))
    index = postings.Postings(lexical.tokens(docs, F.col("terms")), shard_docs=100)
    files = [pq.ParquetFile(f.split(":", 1)[1].replace("///", "/")).metadata for f in index.shards.inputFiles()]
    columns = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert len(columns) > 14 and not any(c.is_stats_set for c in columns)
