"""Ranked search, token alignment and toxicity against brute-force versions: nulls, empty and long texts,
ties, repeated rows, null ids, clashing columns, empty tables."""

import bisect
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.llm import alignment, toxicity, wavelet
from quillmere.llm import textkit as tk

vocabularies = pytest.mark.skipif(not os.path.exists(alignment.BYTE_BPE), reason="no vocabularies")
CLASH = ("item_id", "score", "rank", "shard", "terms", "votes", "predicted", "label", "block", "pair", "n_a", "__id", "__doc", "h")


def say(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def corpus(seed=3, n=70):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(120)]
    texts = [say(r, words, r.randint(1, 80)) + r.choice([".", "!\n", " 42", ""]) for _ in range(n)]
    return [*texts, texts[0], texts[0].upper(), None, "", " \n .,;", "Ünï-cödé x_y 1a2b", say(r, words, 4000), "aa " * 500], words


TEXTS, WORDS = corpus()


# --- ranked search -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_search(rows, items, k=10):
    docs = [(i, Counter(terms_of(t))) for i, t in rows if i is not None]
    n, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        hits = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                hits.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard_bytes", "seeds", "block_items"), [(1 << 23, 32, 1024), (600, 2, 3), (1, 1, 1)])
def test_ranked_search(docs_of, spark, shard_bytes, seeds, block_items):
    rows = [(i * 7 % 101, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[5]), (None, TEXTS[2])]
    r = random.Random(1)
    items = [(i, say(r, WORDS, r.randint(1, 30))) for i in range(8)] + [(20, TEXTS[4]), (21, None), (22, "?!"), (23, "nowhere"), (24, "aa aa aa b"), (25, say(r, WORDS, 900))]
    index = wavelet.WaveletIndex(docs_of(rows, CLASH), shard_bytes=shard_bytes)
    asked = spark.createDataFrame([*items, (None, "a b")], "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(r) for r in index.search(asked, seeds=seeds, block_items=block_items).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(rows, items)


def test_a_repeated_item_is_its_smallest_text(docs_of, spark):
    rows = list(enumerate(TEXTS[:20]))
    asked = spark.createDataFrame([(1, TEXTS[3]), (1, TEXTS[2])], "item_id long, text string")
    got = sorted(tuple(r) for r in wavelet.WaveletIndex(docs_of(rows)).search(asked).collect())
    assert got == brute_search(rows, [(1, min(TEXTS[2], TEXTS[3]))])


def test_search_of_nothing(docs_of, spark):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for rows in ([], [(1, None), (2, "")]):
        index = wavelet.WaveletIndex(docs_of(rows))
        assert index.search(asked).collect() == []
    assert wavelet.WaveletIndex(docs_of([(1, "a b")])).search(asked.limit(0)).collect() == []


def test_most_nodes_are_left_out(docs_of, spark):
    """A rare term's few documents are found without visiting the others."""
    r = random.Random(2)
    rows = [(i, say(r, WORDS, 60) + (" needle" if i % 400 == 7 else "")) for i in range(1600)]
    tally = spark.sparkContext.accumulator(0)
    items = [(1, "needle " + say(r, WORDS, 3))]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in wavelet.WaveletIndex(docs_of(rows)).search(asked, k=4, tally=tally).collect())
    assert got == brute_search(rows, items, 4)
    assert 4 <= tally.value < 1600  # of about 3,200 nodes a shard


def test_hashing_takes_a_piece_at_a_time():
    """Terms hash alike wherever the pieces are cut; a process keeps powers for a piece, not for a shard."""
    data = np.frombuffer(b" ".join(b"%dWord" % (i % 900) for i in range(400_000)), np.uint8)
    starts, ends, _ = tk.runs(wavelet.TERM[data], np.array([0, len(data)]))
    tk._powers.clear()
    got = wavelet._hashed(data, starts, ends)
    assert len(tk._powers["p"]) <= 1 << 21
    want = tk.span_hash(tk.prefix(wavelet._TABLE[tk.LOWER[data]]), starts, ends)
    assert (got == want).all() and (wavelet._hashed(data, starts, ends, 3) == want).all() and len(np.unique(got)) == 900


def test_shards_lie_in_row_groups_of_some_megabytes(spark):
    import pyarrow.parquet as pq

    texts = spark.range(0, 2400, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.md5(F.concat_ws(":", F.col("id"), i))), " ").alias("text"))
    index = wavelet.WaveletIndex(texts, shard_bytes=2_000_000)
    files = [pq.ParquetFile(f.split(":", 1)[1].replace("///", "/")).metadata for f in index.shards.inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 20 and max(g.num_rows for g in groups) <= 14


def test_a_shard_sorts_both_ways():
    """Lists fall by impact at the root, and at every level a node's part of a list still does."""
    chunk = next(tk.chunks(pa.array([t or "" for t in TEXTS])))
    hashes, starts, ends, lists, doc, impact = wavelet.postings(chunk, 50, 9000)
    depth = wavelet._depth(chunk.n)
    values, falls = doc, impact
    for level, bit in enumerate(wavelet._levels(doc, depth)):
        term = np.searchsorted(lists, np.arange(len(doc)), side="right") if level == 0 else term
        node = values >> (depth - level)
        same = (term[1:] == term[:-1]) & (node[1:] == node[:-1])
        assert (falls[1:] <= falls[:-1])[same].all()
        values, falls, term = (np.concatenate([x[~bit], x[bit]]) for x in (values, falls, term))
    assert sorted(zip(doc, impact, strict=True)) == sorted(zip(values, falls, strict=True))


def test_long_inputs_keep_whole_numbers():
    """75 * n * N beyond 64 bits."""
    n = np.array([10**9, 3])
    assert wavelet.impacts(np.array([5, 1]), n, 10**12, 10**14).tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * int(x) * 10**12 // 10**14)) for t, x in zip((5, 1), n, strict=True)]


# --- token alignment -----------------------------------------------------------------------------


def brute_groups(text):
    """Ids of both sides by group, and linked id pairs, from whole-text encodings; None without tokens."""
    tokenizer, model = plain()
    of = alignment._byte_level()
    if not text:
        return None
    e, b = tokenizer.encode(" " + text, add_special_tokens=False), model.encode(text)
    name = model.id_to_piece
    left = [bytes(of[c] for c in t) for t in e.tokens]
    right = [bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode() for i in b]
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return None
    spans = []
    for ids, parts in ((e.ids, left), (b, right)):
        at, out = 0, []
        for i, p in zip(ids, parts, strict=True):
            out.append((at, at + len(p), i))
            at += len(p)
        spans.append(out)
    cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
    groups, links = [], []
    begins = [[x[0] for x in s] for s in spans]
    for lo, hi in zip([0, *cuts], cuts, strict=False):
        one, two = (s[bisect.bisect_left(b, lo) : bisect.bisect_left(b, hi)] for s, b in zip(spans, begins, strict=True))
        groups.append(",".join(str(x[2]) for x in one) + "|" + ",".join(str(x[2]) for x in two))
        links += [(x[2], y[2]) for x in one for y in two if x[0] < y[1] and y[0] < x[1]]
    return len(e.ids), len(b), groups, links


_plain = []


def plain():
    if not _plain:
        import sentencepiece
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(alignment.BYTE_BPE)
        t.encode_special_tokens = True
        _plain.extend([t, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)])
    return _plain


def brute_alignment(rows):
    found = [(i, brute_groups(t)) for i, t in rows]
    counts = Counter(p for _, x in found if x for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = ["<|endoftext|> <s> </s> <0x41>", "a▁b", "  two  blanks ", " x  y 　z", "tab\tand\r\nline \x00", "naïve 東京 🙂 é", "it's they'll ' s", " ", "\n\n x", "x   y", "a" * 300]


@vocabularies
@pytest.mark.parametrize("block_bytes", [4_000_000, 500])
def test_alignment(docs_of, block_bytes):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *ODD, "plain words, and more of them. " * 40])] + [(0, TEXTS[1]), (None, "no id")]
    aligned = alignment.Alignment(docs_of(rows, CLASH), block_bytes=block_bytes)
    assert sorted((tuple(r) for r in aligned.documents().collect()), key=str) == brute_alignment(rows)
    groups = {r["doc_id"]: r["groups"] for r in aligned.groups().where("doc_id > 0").collect()}
    assert groups == {i: ";".join(x[2]) if (x := brute_groups(t)) else "" for i, t in rows if i}


@vocabularies
def test_pairs_of_the_corpus(docs_of):
    rows = list(enumerate(TEXTS[:12]))
    counts = Counter(p for _, t in rows if (x := brute_groups(t)) for p in set(x[3]))
    got = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in alignment.Alignment(docs_of(rows)).pairs().collect()}
    assert got == {p: (n, int(n == max(m for q, m in counts.items() if q[0] == p[0]))) for p, n in counts.items()}


@vocabularies
def test_alignment_of_nothing(docs_of):
    assert alignment.Alignment(docs_of([])).documents().collect() == []


def aligned_text(text):
    with open(alignment.BYTE_BPE, "rb") as f, open(alignment.PIECE_BPE, "rb") as g:
        x = alignment.Aligned(f.read(), g.read(), next(tk.chunks(pa.array([text, "end"]))))
    return bytes(next(x.groups())).decode()


@vocabularies
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'sZ9.\t\n  é▁東<>|")) | st.characters(exclude_categories=("Cs",)), max_size=40))
def test_segments_are_encoded_as_whole_texts_are(text):
    want = brute_groups(text)
    assert aligned_text(text) == (";".join(want[2]) if want else "")


@vocabularies
def test_long_blanks():
    """A run of white space on which the fast encoder's pattern would fail."""
    text = "x" + " " * 200_000 + "y\n" + "\n" * 30_000
    assert aligned_text(text) == ";".join(brute_groups(text)[2])


# --- toxicity ------------------------------------------------------------------------------------


def labelled(seed=4, n=900):
    """Documents of two invented languages; toxic ones hold words with one of two beginnings."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = [stem + "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for stem in ("zuqua", "wyrrt") for _ in range(30)]
    rows, toxic = [], {}
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(10, 200))]
        toxic[i] = int(r.random() < 0.2)
        for _ in range((1 + len(text) // 40) * toxic[i]):
            text[r.randrange(len(text))] = r.choice(bad)
        rows.append((i, " ".join(text).capitalize() + "."))
    return rows, toxic, words


def test_toxicity_of_held_out_rows(docs_of, spark):
    rows, toxic, words = labelled()
    noisy = [(i, 1 - y if i % 50 == 1 else y) for i, y in toxic.items() if i % 4 != 2]  # some labels are wrong
    labels = spark.createDataFrame([*noisy, (None, 1), (10**6, 1), (5, None)], "doc_id long, toxic int")
    extra = [(5000, None), (5001, ""), (5002, "!!! ..."), (5003, " ".join(words) * 200), (5004, "You are a stupid 1d1ot, you pathetic stuuupid loser!!!"), (None, "no id")]
    docs = docs_of([*rows, *extra], ("score", "label", "__id", "h", "a.b"))
    model = toxicity.fit(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.predict(docs, model).collect()}
    assert len(out) == len(rows) + len(extra) and out[3]["label"] == "clash"
    held = [i for i in toxic if i % 4 == 2]
    found = [out[i]["predicted"] for i in held]
    hit = sum(1 for i, p in zip(held, found, strict=True) if p and toxic[i])
    assert hit >= 0.9 * sum(toxic[i] for i in held) and hit >= 0.9 * sum(found)
    assert [out[i]["predicted"] for i in (5000, 5001, 5002, 5003, 5004, None)] == [0, 0, 0, 0, 1, 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())


def test_a_labelled_id_of_many_rows_stays_one(docs_of, spark):
    """The sample stays bounded where rows repeat a labelled id, and repeated rows are scored each."""
    rows, toxic, _ = labelled(n=300)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    hot = [(0, "the same row again and again")] * 500
    once, often = (toxicity.fit(docs_of(x), labels, per_label=50) for x in (rows, rows[1:] + hot))
    assert len(once.lexicon.hashes) and len(often.lexicon.hashes)
    score = {r["score"] for r in toxicity.predict(docs_of(hot[:9]), often).collect()}
    assert len(score) == 1
    known = toxicity.fit(docs_of(rows + rows[:40]), labels, per_label=50)
    assert np.array_equal(known.lexicon.hashes, once.lexicon.hashes) and np.allclose(known.weights, once.weights)


def test_toxicity_of_nothing(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs_of([(1, "a")]), none)
    assert toxicity.predict(docs_of([]), model).collect() == []
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(docs_of([(1, "you idiot"), (2, "all well")]), model).collect()}
    assert got == {1: 1, 2: 0}


def chunk_votes(texts):
    words = toxicity.Words(next(tk.chunks(pa.array(texts))))
    lexicon = toxicity.Lexicon()
    votes = lexicon.votes(words, lexicon.hits(words))
    return [{v for i, v in enumerate(toxicity.VOTERS) if int(x) >> i & 1} for x in votes]


def test_patterns():
    got = chunk_votes(["you are such an idiot", "an 1d10t", "stuuupid", "f*ck it", "LOUD WORDS HERE now", "well!!!", "oh shut up", "idiot", "shut", "up you"])
    assert [x & set(toxicity.PATTERNS) for x in got] == [{"addressed"}, {"masked"}, {"stretched"}, {"starred"}, {"shouting"}, {"exclaiming"}, {"hostile"}, set(), set(), set()]
    assert "insult_any" in got[0] and "insult_any" in got[7] and not got[8]


def sampled_votes(r, n, pairs):
    """Voters of stated rates in each class; voter j copies voter i with a chance."""
    y = (r.random(n) < 0.2).astype(int)
    x = r.random((n, len(toxicity.VOTERS))) < np.where(y[:, None] == 1, 0.6, 0.05)
    for i, j in pairs:
        copy = r.random(n) < 0.9
        x[copy, j] = x[copy, i]
    return y, (x.astype(np.int64) << np.arange(len(toxicity.VOTERS))).sum(axis=1)


def test_label_model_finds_rates_and_copies(spark):
    r = np.random.default_rng(0)
    pairs = [(0, 3), (5, 9)]
    y, votes = sampled_votes(r, 20_000, pairs)
    u, n = np.unique(votes, return_counts=True)
    patterns = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, n, strict=True)], "votes long, n long")
    told = y[:400].copy()
    told[:20] = 1 - told[:20]
    model, right = toxicity.fit_label_model(patterns, votes[:400], told)
    assert abs(model.prior[1] - 0.2) < 0.01
    assert np.abs(model.accuracy[1] - 0.6).max() < 0.03 and np.abs(model.accuracy[0] - 0.05).max() < 0.02
    edges = {frozenset((int(p), i)) for i, p in enumerate(model.parent) if p >= 0}
    assert all(frozenset(p) in edges for p in pairs)
    assert 0.88 < right[0] < 0.99
    q = toxicity.posterior(model, right, votes[:20], told[:20])
    assert ((q > 0.5) == (y[:20] == 1)).all()  # votes outweigh a wrong label


def test_training_reaches_the_optimum():
    r = np.random.default_rng(1)
    x = (r.random((200, 6)) < 0.3).astype(float)
    q = 1 / (1 + np.exp(-(x @ np.array([2, -1, 0, 1, 0, 3.0]) - 1)))
    row, column = np.nonzero(x)
    w = toxicity.train(row, column, x[row, column], 200, 6, q, np.ones(200), np.arange(6) / 9, penalty=0.1, rounds=3000)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = x.T @ (p - q) + 0.1 * (w[:-1] - np.arange(6) / 9)
    assert np.abs(slope).max() < 1e-3 and abs((p - q).sum()) < 1e-3


