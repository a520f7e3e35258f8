from decimal import Decimal

from pyspark.sql import functions as F

from quillmere.functions import numbers as N
from quillmere.functions import text as T
from quillmere.functions import vectors as V


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_tokenizer_keeps_identifiers_and_makes_bigrams(spark):
    r = one(spark, "Policy HR-2026/01 ＡＢＣ 差旅报销 费 straße", T.tokenize(F.col("x")))[0]
    assert r == ["policy", "hr-2026/01", "abc", "差旅报销", "差旅", "旅报", "报销", "费", "strasse"]


def test_long_cjk_run_gives_only_bigrams(spark):
    r = one(spark, "一二三四五六七八九", T.tokenize(F.col("x")))[0]
    assert r == ["一二", "二三", "三四", "四五", "五六", "六七", "七八", "八九"]


def test_numbers(spark):
    cases = {"12": 12, "十": 10, "十二": 12, "二十": 20, "三十五": 35, "1,200.5": Decimal("1200.5"), "百": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: r[1] for r in df.select("x", N.small_number(F.col("x"))).collect()}
    assert got == cases


def test_money_days_and_dates(spark):
    m = lambda s, commas=True: one(spark, s, N.money(F.col("x"), ("总金额", "预算"), ("采购",), commas))[0]
    assert m("购买三台，每台1,500元") == 4500
    assert m("预算约2.5万元") == 25000
    assert m("8000元的采购") == 8000
    assert m("没有数字") is None
    assert one(spark, "请假半天", N.days(F.col("x")))[0] == Decimal("0.5")
    assert one(spark, "两个工作日", N.days(F.col("x")))[0] == 2
    assert one(spark, "两个工作日", N.leave_days(F.col("x")))[0] is None
    assert [str(d) for d in one(spark, "2026-08-05 2026/08/05 2026年08月07日 2026-8-5", N.dates(F.col("x")))[0]] == ["2026-08-05", "2026-08-07"]
    assert one(spark, "1234567.50", N.plain_decimal(F.col("x").cast("decimal(18,2)")))[0] == "1,234,567.5"
    assert one(spark, "1000", N.plain_decimal(F.col("x").cast("decimal(18,2)")))[0] == "1,000"


def test_labels_versions_and_fences(spark):
    assert one(spark, "用途：研发，型号: X-1", T.labelled_value(F.col("x"), ("用途",)))[0] == "研发"
    assert one(spark, "成本中心 CC-01/2", T.labelled_code(F.col("x"), ("成本中心",)))[0] == "CC-01/2"
    assert one(spark, "v2.1-beta", T.normalized_version(F.col("x")))[0] == "v2_1_beta"
    assert one(spark, "--", T.normalized_version(F.col("x")))[0] == "unknown"
    assert one(spark, '```json\n{"a":1}\n```', T.json_body(F.col("x")))[0] == '{"a":1}'
    assert one(spark, "see [S2] and [S1] and [S2]", T.cited_ids(F.col("x")))[0] == ["S2", "S1"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],)], "v array<double>")
    r = df.select(V.norm(F.col("v")), V.invalid_reason(F.col("v"), 2)).collect()
    assert r[0][0] == 5.0
    assert [x[1] for x in r] == [None, "zero", "dimension", "missing", "not_finite"]
    assert one(spark, "[1, 2.5]", V.parse_literal(F.col("x")))[0] == [1.0, 2.5]
    e = one(spark, "policy", V.hash_embedding(64)(F.col("x")))[0]
    assert abs(sum(x * x for x in e) - 1) < 1e-9
    e = one(spark, "policy", V.digest_embedding(F.col("x"), 8))[0]
    assert len(e) == 8 and abs(sum(x * x for x in e) - 1) < 1e-9


def test_small_text_functions(spark):
    from pyspark.sql import functions as F

    from quillmere.functions import numbers as N
    from quillmere.functions import text as T

    df = spark.createDataFrame([(' {"a":"1","b":null} ', "改成3台，修改为4台", ["b", " ", "a ", None])], "j string, r string, l array<string>")
    r = df.select(T.json_map(F.col("j")).alias("m"), T.json_map(F.lit("[oops")).alias("none"), T.normalized_revision(F.col("r")).alias("r"), T.string_list(F.col("l")).alias("l"), T.string_list(F.lit("x "), scalar=True).alias("one"), T.sorted_json(F.array(F.lit("b"), F.lit("a"))).alias("s"), T.union_sorted(F.array(F.lit("c"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("u")).first()
    assert r.m == {"a": "1", "b": None} and r.none == {} and r.r == "为3台，为4台" and r.l == ["b", "a"] and r.one == ["x"] and r.s == '["a","b"]' and r.u == ["a", "b", "c"]
    import hashlib

    d = spark.range(1).select(T.stable_digest(z=F.lit(1), a=F.lit(None).cast("string"), m=F.lit("x")).alias("d"), N.plain(F.lit("1200.500").cast("decimal(18,3)")).alias("p"), N.plain(F.lit(30).cast("decimal(18,2)")).alias("q"), N.hash_score(F.lit("q"), F.lit("t")).alias("h")).first()
    assert d.d == hashlib.sha256(b'{"a":null,"m":"x","z":1}').hexdigest() and d.p == "1200.5" and d.q == "30" and 0 <= d.h <= 1
    assert d.h == int(hashlib.sha256(b"q\x00t").hexdigest()[:12], 16) / (16**12 - 1)


def test_stable_characters(spark):
    """Every character that counts as stable is its own normal form, alone and beside each other, and nothing else of use is lost."""
    import re
    import unicodedata

    chars = [chr(i) for i in range(0x250)]
    stable = [c for c in chars if re.fullmatch(T.STABLE.replace("\\\\", "\\"), c)]
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in stable for b in stable) and {"ß", "é", "ñ", "ü", "¿"} <= set(stable)
    assert not {"\u00a0", "ª", "²", "µ", "¼", "\u00ad", "¨", "\u0301", "İ", "ı", "ſ"} & set(stable)
    rows = spark.createDataFrame([("plain",), ("Größe ¿qué?",), ("e\u0301",), ("ﬁ",), ("a\u00a0b",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.is_stable(F.col("t"))).collect()] == [True, True, False, False, False, False, True]
