import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmere import sources, streaming
from quillmere.operators import buckets, chunking, state, workflow
from quillmere.sources import datasource

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _docx() -> bytes:
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p("Title", "Heading1") + p("text") + f"<w:tbl>{row('a|b', 'c')}{row('d')}</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_loaders(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿# hi\nthere", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(_docx())
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = {r.stem: r for r in sources.Registry().load(spark, str(tmp_path)).collect()}
    assert rows["a"].text == "# hi\nthere" and rows["c"].error == "BadZipFile"
    assert rows["b"].text.split("\n") == ["# Title", "text", r"| a\|b | c |", "| --- | --- |", "| d |  |"] and list(rows["b"].line_blocks) == [1, 2, 3, 3, 3]
    with pytest.raises(ValueError):
        sources.Registry().register(".md", "again", None)


def test_documents_as_a_data_source(spark, tmp_path):
    """The format gives what the registry loads; filters keep files closed; a stream takes new files once."""
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("\ufeff# hi\nthere", encoding="utf-8")
    (folder / "b.docx").write_bytes(_docx())
    (folder / "c.DOCX").write_bytes(b"broken")
    (folder / "d.md").write_text(" ", encoding="utf-8")
    (folder / "e.txt").write_text("no loader", encoding="utf-8")
    (folder / "sub").mkdir()
    registry = sources.Registry()
    datasource.register(spark, registry)
    got = spark.read.format("documents").load(str(folder))
    rows = {r.stem: (r.loader, r.text, r.line_blocks and list(r.line_blocks), r.error) for r in got.collect()}
    loaded = {r.stem: (r.loader, r.text, r.line_blocks and list(r.line_blocks), r.error) for r in registry.load(spark, str(folder)).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["c"] == ("docx", None, None, "BadZipFile") and {k: v for k, v in rows.items() if k != "c"} == {k: v for k, v in loaded.items() if k != "c"}
    assert got.rdd.getNumPartitions() == 4
    one = got.where("loader = 'docx' and stem in ('b', 'x')")
    assert [r.stem for r in one.collect()] == ["b"] and one.rdd.getNumPartitions() == 1
    stream = spark.readStream.format("documents").load(str(folder))
    run = lambda: stream.select("stem", "error").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    (folder / "f.md").write_text("new", encoding="utf-8")
    run()
    run()
    assert sorted(r.stem for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c", "d", "f"]


def test_nested_headers(spark):
    header = "title: A: no\nx: 1", "title: T\nscope:\n  departments: [HR, IT]\n  open: true\nnone:", "- a", "", None
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(header)], "i int, h string").select("i", chunking.nested_header(F.col("h")).alias("p"))
    got = {r.i: (r.p.fields, r.p.error) for r in rows.collect()}
    assert got[1] == ({"title": "T", "scope.departments.0": "HR", "scope.departments.1": "IT", "scope.open": "true", "none": None}, None)
    assert got[0] == (None, "ScannerError") and got[2] == (None, "no_mapping") and got[3] == (None, "empty") and got[4] == (None, None)


def test_json_lines_and_web(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"id":"a"}\n{"id":"a"}\nnot json\n', encoding="utf-8")
    rows, problems = sources.json_lines(spark, str(f), "id string", "id")
    assert rows.count() == 2 and {r.problem for r in problems.collect()} == {"malformed", "repeated"}
    raw = spark.createDataFrame([(1, "u", " t  x ", "s" * 700, 1), (1, "u", "again", "s", 2), (1, "v", "t", "s", 3)], "query_id long, url string, title string, snippet string, position int")
    got = sources.web_results(raw).orderBy("position").collect()
    assert [(r.url, r.title, len(r.snippet)) for r in got] == [("u", "t x", 600), ("v", "t", 1)] and sources.empty_web_results(spark).count() == 0


def test_lines_of_a_dataset(spark, tmp_path):
    f = tmp_path / "y.jsonl"
    f.write_bytes('\ufeff{"id":"a","n":1}\r\n\n{"id":"b"}\n[1]\n{"id":"a"}'.encode())
    rows, problems = sources.json_lines(spark, str(f), "id string, n int", "id")
    assert sorted((r.line_no, r.id, r.n) for r in rows.collect()) == [(1, "a", 1), (3, "b", None), (5, "a", None)]
    assert sorted((r.problem, r.line_no) for r in problems.collect()) == [("malformed", 4), ("repeated", 5)]
    import hashlib

    assert sources.file_digests(spark, str(f)).first().sha256 == hashlib.sha256(f.read_bytes()).hexdigest()


def test_sidecars_and_discovery(spark, tmp_path):
    (tmp_path / "b.docx").write_bytes(_docx())
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "c.md").write_text("# x", encoding="utf-8")
    (tmp_path / "z.txt").write_text("no", encoding="utf-8")
    (tmp_path / "b.metadata.yaml").write_text("\ufefftitle: B\n", encoding="utf-8")
    (tmp_path / "a.metadata.yaml").write_text(" \n", encoding="utf-8")
    reg = sources.Registry()
    assert [r.path.rsplit("/", 1)[1] for r in reg.discover(spark, str(tmp_path)).collect()] == ["a.docx", "b.docx", "c.md"]
    got = {r.stem: (r.header, r.error) for r in sources.with_sidecars(reg.load(spark, str(tmp_path)), sources.sidecars(spark, str(tmp_path))).collect()}
    assert got == {"a": ("", "missing_metadata"), "b": ("title: B", None), "c": (None, None)}


def test_recognised_images(spark):
    df = spark.createDataFrame([("d", 1, b"ab"), ("d", 2, b"x" * 50), ("d", 3, b"bad")], "doc string, unit int, content binary")

    def words(image):
        if image == b"bad":
            raise ValueError("no image")
        return [("hello", 0.9), (" ", 0.1), ("you", 0.7), ("?", None)]

    got = {r.unit: (r.text, r.confidence, r.error) for r in sources.recognised(df, words, most_bytes=10).collect()}
    assert got[1][0] == "hello you ?" and abs(got[1][1] - (0.9 + 0.1 + 0.7) / 3) < 1e-9 and got[2][2] == "too_large" and got[3][2] == "ValueError"
    assert {r.error for r in sources.recognised(df).collect()} == {"RuntimeError"}


def test_web_results_hide_secrets(spark):
    raw = spark.createDataFrame([(1, "u", "password: hunter2", "bearer abcdefghijk x", 1)], "query_id long, url string, title string, snippet string, position int")
    r = sources.web_results(raw).first()
    assert r.title == "[REDACTED]" and r.snippet == "[REDACTED] x"
    with pytest.raises(ValueError):
        sources.web_results(raw, 6)


def test_markdown_report(spark):
    df = spark.createDataFrame([(2, "b|c"), (1, None)], "n int, v string")
    assert sources.markdown_report(df, "Report", "n").first().markdown == "# Report\n\n| n | v |\n| --- | --- |\n| 1 |  |\n| 2 | b\\|c |"


def test_ocr(spark):
    w = spark.createDataFrame([("d", 1, 1, 1, 1, 2, "world", 80.0), ("d", 1, 1, 1, 1, 1, "hello", 100.0), ("d", 1, 1, 1, 1, 3, "!", -1.0)], "doc string, page int, block int, par int, line int, n int, text string, conf double")
    l = sources.ocr_lines(w).first()
    assert l.text == "hello world !" and l.confidence == 0.9
    g = spark.createDataFrame([("x" * 20, 0.9), ("x" * 19, 0.9), ("x" * 30, 0.5)], "text string, confidence double")
    assert [r.rejected for r in sources.ocr_gate(g).collect()] == [None, "too_short", "low_confidence"]


def _drain(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2026-01-01 {i // 6:02d}:{i % 6 * 10:02d}:00", i % 3, "a" if i % 2 else "b", float(i)) for i in range(48)]
    e = spark.createDataFrame(rows, "event_id int, t string, user_id int, event_type string, value double").withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    e.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    batch = {tuple(r) for r in streaming.windowed(streaming.event_time(e), "1 hour", "30 minutes").collect()}
    assert {tuple(r) for r in _drain(streaming.windowed(streaming.event_time(stream), "1 hour", "30 minutes"), "complete", "w", tmp_path).collect()} == batch
    twice = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    d = streaming.deduplicated(streaming.event_time(twice), ["user_id", "event_type"])
    assert _drain(d.select("user_id", "event_type"), "append", "d", tmp_path).count() == 6


def test_streaming_memory(spark, tmp_path):
    m = spark.createDataFrame([("s", r, r) for r in ("user", "assistant", "user")], "session_id string, role string, content string").coalesce(1)
    m.write.parquet(str(tmp_path / "m"))
    out = _drain(streaming.memory(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), 1, ttl_minutes=None), "append", "mem", tmp_path)
    assert [(r.turn, r.role, r.oldest_kept) for r in out.collect()] == [(1, "user", 1), (1, "assistant", 1), (2, "user", 2)]


def test_streaming_memory_in_order_and_without_secrets(spark, tmp_path):
    m = spark.createDataFrame([("s", "user", "third", 3), ("s", "assistant", "token: abc", 2), ("s", "user", "first", 1), ("s", "user", " \t", 4)], "session_id string, role string, content string, at int")
    m.write.parquet(str(tmp_path / "m"))
    out = _drain(streaming.memory(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), order="at", ttl_minutes=None), "append", "mem2", tmp_path)
    assert sorted((r.turn, r.role, r.content) for r in out.collect()) == [(1, "assistant", "[REDACTED]"), (1, "user", "first"), (2, "user", "third")]


def test_memory_of_a_replayed_stream(spark, tmp_path):
    """Batch by batch the state holds what the batch operator retains, and no more than its turns."""
    schema, rows = "session_id string, role string, content string, at int", []
    for i in range(40):
        rows.append((f"s{i % 3}", "user" if i % 2 == 0 or i % 7 == 0 else "assistant", f"text {i}", i))
    (tmp_path / "m").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "m"))
    for part in (rows[:11], rows[11:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
        out = streaming.memory(stream, 2, order="at", ttl_minutes=None)
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    kept = {tuple(r) for r in state.retained(got, 2).select("session_id", "turn", "role", "content").collect()}
    turns, want = {}, []
    for s, role, content, _ in rows:
        turns[s] = turns.get(s, 0) + (role == "user")
        want.append((s, max(turns[s], 1), role, content))
    assert {tuple(r) for r in got.select("session_id", "turn", "role", "content").collect()} == set(want)
    assert kept == {w for w in want if w[1] > turns[w[0]] - 2}
    last = {r.session_id: r for r in got.where("session_id is not null").orderBy(F.col("turn"), F.size("context")).collect()}
    assert all(r.n_held <= sum(1 for w in want if w[0] == s) and r.oldest_kept == max(1, r.turn - 1) for s, r in last.items())
    assert max(r.n_held for r in got.collect()) < 14 and {r.context[-1].split(": ")[1] for r in got.where("content = 'text 39'").collect()} == {"text 39"}


def test_workflow_sessions_equal_the_batch(spark, tmp_path):
    """Turns over several micro-batches run through the states of the batch, and idle sessions are closed."""
    schema, words = "session_id string, at timestamp_ntz, text string, ready boolean", ["生成采购申请草稿", "预算编号 B-01", "确认", "提交审批。", "谁审批", "取消草稿", "修改数量为3台"]
    rows = [(f"s{i % 4}", datetime.datetime(2026, 1, 1, 8, i % 60), words[(i * 5 + i // 7) % 7], i % 3 == 0) for i in range(56)]
    late = [("end", datetime.datetime(2026, 1, 1, 20, i), "谁审批", False) for i in (0, 50)]
    (tmp_path / "t").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "t"))
    for part in (rows[:20], rows[20:], late[:1], late[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        out = streaming.workflow_sessions(stream, ready=F.col("ready"))
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.createDataFrame([(s, sum(1 for r in rows[:n] if r[0] == s) + 1, t, ready) for n, (s, _, t, ready) in enumerate(rows)], "session_id string, turn long, text string, ready boolean")
    columns = ["session_id", "turn", "draft_status", "pending", "revision", "outcome", "nodes"]
    want = sorted(map(str, workflow.workflow(batch, ready=F.col("ready")).select(*columns).collect()))
    assert sorted(map(str, got.where("outcome <> 'abandoned' and session_id <> 'end'").select(*columns).collect())) == want
    assert {r.session_id for r in got.where("outcome = 'abandoned'").collect()} >= {"s0", "s1", "s2", "s3"}


def test_sync_files(spark, tmp_path):
    """Rows of every batch arrive once, also when a batch is played again."""
    schema = "id long, v string, at int, gone boolean"
    table = buckets.BucketTable(spark, str(tmp_path / "t"), "id long, v string", buckets=4)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate(([(1, "a", 1, None), (2, "b", 1, False), (1, "c", 2, False)], [(2, None, 3, True), (3, "d", 3, False)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.sync_files(stream, table, str(tmp_path / "cp"), deleted="gone", order="at").start().awaitTermination(60)
        assert table.applied() == list(range(i + 1))
    want = [(1, "c"), (3, "d")]
    assert sorted(map(tuple, table.read().collect())) == want
    table.apply(spark.createDataFrame([(2, "late")], "id long, v string"), batch=0)  # played again
    assert sorted(map(tuple, table.read().collect())) == want and table.applied() == [0, 1]


def test_upserts_leave_other_buckets_alone(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    t = buckets.BucketTable(spark, str(tmp_path / "b"), "id long, v string", buckets=16)
    assert t.apply(rows) == list(range(16)) and t.read().count() == 1000
    files = lambda: {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in (tmp_path / "b").glob("*/*.parquet")}
    before, new = files(), spark.createDataFrame([(5, "new"), (2000, "more")], "id long, v string")
    touched = t.apply(new, spark.createDataFrame([(7,)], "id long"))
    after = files()
    assert 1 <= len(touched) <= 3 and {b for b in before if before[b] != after[b]} == {f"__bucket={b}" for b in touched}
    got = dict(map(tuple, t.read().collect()))
    assert len(got) == 1000 and got[5] == "new" and got[2000] == "more" and 7 not in got and got[8] == "v8"
    # A bucket that loses all of its rows is empty afterwards.
    gone = t.read().where(t.bucket(F.col("id")) == touched[0])
    t.apply(rows.limit(0), gone.select("id"))
    assert t.read().where(t.bucket(F.col("id")) == touched[0]).count() == 0 and 800 < t.read().count() < 1000
    for bad, gone in (([(1, "a"), (1, "b")], []), ([(None, "a")], []), ([(1, "a")], [(1,)])):
        with pytest.raises(ValueError):
            t.apply(spark.createDataFrame(bad, "id long, v string"), spark.createDataFrame(gone, "id long"))
