import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.llm import decontam, exchange, lpf, mixing, simhash, topk
from quillmere.llm import textkit as tk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b.", max_size=40), max_size=8), st.integers(1, 64))
def test_words_and_chunks(texts, size):
    got = []
    for c in tk.chunks(pa.array(texts, pa.string()), size):
        s, e, d = c.words()
        for i in range(c.n):
            got.append([c.data[a:b].tobytes().decode() for a, b, k in zip(s, e, d, strict=True) if k == i])
    assert got == [WORDS.findall(t) for t in texts]


def test_sliding_min_rolling_and_packing():
    x = np.random.default_rng(0).integers(0, 100, 57).astype(np.uint64)
    for w in (1, 2, 7, 57, 60):
        assert tk.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]
    pre = tk.prefix(x)
    h = tk.rolling(pre, 5)
    assert len(h) == 53 and h[3] == tk.span_hash(pre, np.array([3]), np.array([8]))[0]
    assert tk.unpacked(tk.packed(x), np.uint64).tolist() == x.tolist()
    sliced = pa.array(["zz", None, "b c"]).slice(1)
    assert [c.data.tobytes() for c in tk.chunks(sliced)] == [b"b c"]


def test_xxh64_of_many_lengths():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 4000).astype(np.uint8)
    a = r.integers(0, 3500, 400)
    b = a + r.integers(0, 400, 400)
    assert simhash.xxh64(data, a, b).tolist() == [xxhash.xxh64(data[i:j].tobytes(), seed=42).intdigest() for i, j in zip(a, b, strict=True)]


def previous_factors(s):
    """The longest previous factor of each position, by comparing all pairs."""
    n = len(s)
    return [max([0] + [max(m for m in range(n - i + 1) if s[j : j + m] == s[i : i + m]) for j in range(i)]) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=40).map(str.encode), st.sampled_from([1, 2, 5, 8, 11]))
def test_repeats_are_long_previous_factors(s, length):
    data = np.frombuffer(s, np.uint8)
    at, rank = lpf.prefix_ranks(data, len(s) - np.arange(len(s)), length)
    assert set(at[lpf.repeats(at, rank, at)].tolist()) == {i for i, f in enumerate(previous_factors(s)) if f >= length}
    # Whatever the order of the corpus, the first of each kind is no repeat and all others are.
    age = np.random.default_rng(len(s)).permutation(len(s))[at]
    on = lpf.repeats(at, rank, age)
    assert on.tolist() == [any(age[j] < age[i] and rank[j] == rank[i] for j in range(len(at))) for i in range(len(at))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=30).map(str.encode), min_size=1, max_size=5), st.sampled_from([1, 3, 8, 12, 20]))
def test_repeats_are_factors_over_a_threshold(texts, length):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    room = ends[np.searchsorted(ends, np.arange(len(data)), side="right")] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    at, rank = lpf.prefix_ranks(data, room, length)
    seen, want = set(), []
    for p in at:
        w = data[p : p + length].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert lpf.repeats(at, rank, at).tolist() == want


def peak_mb(work):
    """MB that numpy holds at once while ``work`` runs, beyond what it held before."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_factors_of_a_full_slice_take_a_bounded_room():
    r = np.random.default_rng(3)
    size, n = 200, 5000
    data = r.integers(97, 123, (n, size)).astype(np.uint8)
    data[1::2, 49], data[1::2, 50:] = 65, data[::2, 50:]  # each second context shares its last 150 bytes with the one before
    table = pa.table({"block": np.zeros(n, np.int64), "id": np.arange(n), "row": np.arange(n), "start": np.zeros(n, np.int64), "h": np.arange(n, dtype=np.uint64) // np.uint64(2), "data": pa.array([x.tobytes() for x in data], pa.binary())})
    d, out = lpf._Dedup("doc_id", "text", 100, 32, 1, 2 << 20, None), []
    room = peak_mb(lambda: out.append(d.factors(0, {lpf.CONTEXTS: [exchange.to_ipc(table)]})))
    _, _, rows, lo, hi = exchange.unpack(out[0].column("body").to_pylist(), *d.spans.dtypes)
    assert rows.tolist() == list(range(1, n, 2)) and set(lo.tolist()) == {50} and set(hi.tolist()) == {200}
    assert room < 72


def test_anchors_of_a_block_take_a_bounded_room():
    text = np.random.default_rng(4).integers(97, 123, 3 << 20).astype(np.uint8).tobytes().decode()
    table = pa.table({"doc_id": np.arange(3072), "text": [text[i : i + 1024] for i in range(0, len(text), 1024)]})
    d = lpf._Dedup("doc_id", "text", 100, 32, 8, 2 << 20, None)
    tk._powers.clear()
    assert peak_mb(lambda: d.find(0, [exchange.to_ipc(table)])) < 85


def test_an_exchange_has_a_partition_for_several_keys():
    assert [exchange.partitions(k, 6) for k in (1, 10, 42, 206, 20_000)] == [1, 10, 18, 52, 5000]
    assert exchange.partitions(10**7, 6) == exchange.MOST_PARTITIONS and exchange.partitions(206, 1000) == 206


def test_walk_of_a_dense_bucket_reaches_the_smallest():
    base = np.uint64(0x0F0F0F0F0F0F0F0F)
    fp = np.sort(np.array([base ^ np.uint64(1 << i) for i in range(40)] + [base ^ np.uint64(0x3FF)], np.uint64))
    members, roots = simhash._walk(fp, 4)
    assert len(set(roots.tolist())) == 1 and len(members) == 39  # the last differs by more than four bits from all


def test_water_level():
    assert mixing.water_level([10, 10, 10], [5, 2, 1], 3) == [18.75, 7.5, 3.75]
    assert mixing.water_level([1, 100], [5, 2], 3) == [3.0, 98.0]
    assert mixing.water_level([5], [5], 3) == [5.0]


def test_large_components_stay_exact():
    q, m = topk._exactly(*[np.array([[2.0**40, 1.0]])] * 2)
    assert (q @ m.T)[0, 0] == topk._resolved(q, m, np.zeros(1, int), np.zeros(1, int), np.arange(2))[0] == 2**80 + 1 and topk._long(2**80) == 2**63 - 1


def test_template_tokens():
    c = next(tk.chunks(pa.array(["In 2020 Anna paid 35 kg."])))
    assert decontam.Tokens(c).kind.tolist() == [0, decontam.NUMBER, decontam.NAME, 0, decontam.NUMBER, decontam.UNIT]


def test_names_in_many_places_cost_little_more_than_in_one():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    masks = [m for m in range(1, 256) if m.bit_count() <= 4]
    items = {
        kind: [(i, " ".join(word().capitalize() if m >> j & 1 else word() for j in range(8))) for i, m in enumerate(ms)]
        for kind, ms in (("one", [1] * len(masks)), ("many", masks))
    }
    changed = [" ".join(w if w[0].islower() else word() for w in t.split()) for _, t in items["many"]]
    plain, renamed = (next(tk.chunks(pa.array(texts))) for texts in ([" ".join(word() for _ in range(100_000))], changed))
    seconds = {}
    for kind, rows in items.items():
        index = decontam.Index(rows, 8, 5)
        for _ in range(5):
            start = time.process_time()
            assert not list(decontam._matches(index, plain, 0.5))
            seconds[kind] = min(seconds.get(kind, 1e9), time.process_time() - start)
    assert {(d, i) for d, i, *_ in decontam._matches(index, renamed, 0.5)} == {(i, i) for i in range(len(masks))}
    assert seconds["many"] < 2.5 * seconds["one"], seconds


def test_windows_with_names_by_brute_force():
    r = random.Random(9)
    word = lambda: r.choice(["ab", "cd", "ef", "Ab", "Cd", "7", "12", "kg"])
    say = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(say(r.choice([5, 6, 7, 8, 9, 14])))) for i in range(30)]
    texts = [" ".join([*say(3), *(w if r.random() < 0.8 else word() for w in r.choice(items)[1].split()), *say(3)]).lower() for _ in range(40)]
    index, t = decontam.Index(items, 8, 5), decontam.Tokens(next(tk.chunks(pa.array(texts))))
    got = {(int(p), int(a), w) for pos, at, w, exact in index.plain.hits(t, index.seen) if not exact for p, a in zip(pos, at, strict=True)}
    view, plain = index.plain.view, np.where(t.plain == 0, t.literal, t.plain.astype(np.uint64))
    want, item = set(), np.where((view.kind == 0) | (view.kind == decontam.NAME), view.literal, view.kind.astype(np.uint64))
    for a in range(len(item)):
        w = min(8, int((view.doc == view.doc[a]).sum()))
        if a + w <= len(item) and view.doc[a + w - 1] == view.doc[a] and (view.kind[a : a + w] == 0).sum() >= (w + 1) // 2:
            wild = view.kind[a : a + w] == decontam.NAME
            want |= {(p, a, w) for p in range(len(plain) - w + 1) if t.doc[p] == t.doc[p + w - 1] and ((plain[p : p + w] == item[a : a + w]) | wild).all()}
    assert got == want and {w for _, _, w in got} == {5, 6, 7, 8}


def test_large_buckets_are_split_without_losing_links():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**43, 300).astype(np.uint64) << np.uint64(21)
    near = [b ^ np.uint64(sum(1 << int(i) for i in r.choice(43, r.integers(0, 6), replace=False) + 21)) for b in base[:150]]
    chain = [base[0]]
    for _ in range(20):
        chain.append(chain[-1] ^ np.uint64(sum(1 << int(i) for i in r.choice(43, 4, replace=False) + 21)))
    fp = np.unique(np.concatenate([base, near, chain]))
    want = dict(zip(*simhash._walk(fp, 4), strict=True))
    for small in (1 << 20, 4):
        got = dict(zip(*simhash._within(fp, (0, 21), 4, small), strict=True))
        assert got == want and len(want) > 100
