"""Each operator against a brute-force version on a small fixture with the awkward cases:
nulls, empty texts, repeated rows, ties, a long text, null ids, clashing columns, empty tables."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmere.llm import components, decontam, langid, linededup, lpf, mixing, quality, simhash, substring, tokens, topk
from quillmere.llm.workspace import Workspace

W = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared, line = [say(40) for _ in range(3)], "A Common Line Of Text"
    texts = []
    for i in range(n):
        parts = [say(r.randint(1, 60)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, r.choice(shared))
        if i % 2 == 0:
            parts.append(r.choice([line, f"  {line.upper()}\t", line + "é"]))
        texts.append("\n".join(parts))
    texts += [texts[0], texts[1], None, "", " \n\t ", "short", "é" * 130, "ab" * 900, "word " * 500, say(6000)]
    return texts


TEXTS = corpus()


# --- line dedup ----------------------------------------------------------------------------------


def _key(line):
    k = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute_lines(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(_key(line)) >= 10:
                holders[_key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(holders[_key(x)]) > 1 and i > min(holders[_key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (5, 2), (3, 3)])
def test_line_dedup(docs_of, batches, fan_in):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[2]), (4, "another text of one id\n" + TEXTS[2])]
    got = linededup.dedup_lines(docs_of(rows, ("kept", "pos", "first")), batches=batches, fan_in=fan_in).select("doc_id", "n_lines", "n_dropped", "kept", "pos")
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute_lines(rows)


def test_line_dedup_of_nothing(docs_of):
    assert linededup.dedup_lines(docs_of([])).count() == 0


# --- suffix and substring dedup ------------------------------------------------------------------


def brute_bytes(rows, length):
    seen, out = {}, []
    for i, t in ((i, (t or "").encode()) for i, t in rows if i is not None):
        for p in range(len(t) - length + 1):
            k = t[p : p + length]
            seen[k] = min(seen.get(k, (i, p)), (i, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if i is not None and seen[b[p : p + length]] < (i, p):
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


#: Rows that repeat an id, with one text and with several, and null ids.
ODD = [(0, TEXTS[0]), (None, TEXTS[0]), (4, "other words " + TEXTS[9] + TEXTS[0]), (4, TEXTS[9]), (70, TEXTS[2]), (70, TEXTS[2])]


@pytest.mark.parametrize(("slice_bytes", "block_bytes", "fan"), [(3 << 20, 4 << 20, None), (400, 4 << 20, None), (2000, 9000, None), (400, 4000, 3)])
def test_suffix_dedup(docs_of, slice_bytes, block_bytes, fan):
    rows = [*enumerate(TEXTS), *ODD]
    got = lpf.dedup_suffixes(docs_of(rows, ("kept", "block", "kind", "key")), slice_bytes=slice_bytes, block_bytes=block_bytes, fan=fan)
    assert "block" in got.columns
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 100)


def brute_words(rows, window):
    first, out = {}, []
    split = [(i, W.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "block_bytes", "fan"), [(13, 4 << 20, None), (5, 4 << 20, None), (13, 9000, None), (5, 4000, 3)])
def test_substring_dedup(docs_of, window, block_bytes, fan):
    rows = [*enumerate(TEXTS), *ODD]
    got = substring.dedup_substrings(docs_of(rows, ("kept", "block", "key")), window=window, block_bytes=block_bytes, fan=fan).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_words(rows, window)


def test_several_texts_of_one_id_are_one_document(docs_of):
    a, b = "x" * 150, "y" * 150
    rows = [(1, a), (1, b), (0, "z" * 150 + " " + a), (2, b)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in lpf.dedup_suffixes(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 100) and (1, 150, 150, 1, b"") in got
    words = " ".join(map(str, range(20)))
    got = [(r.doc_id, r.n_removed) for r in substring.dedup_substrings(docs_of([(1, words), (1, "other"), (2, words)])).collect()]
    assert sorted(got) == [(1, 0), (1, 0), (2, 20)]


def test_dedup_of_nothing(docs_of):
    assert lpf.dedup_suffixes(docs_of([])).count() == 0 and substring.dedup_substrings(docs_of([])).count() == 0
    assert [r.n_removed for r in lpf.dedup_suffixes(docs_of([None, "a"])).collect()] == [0, 0]
    with pytest.raises(ValueError):
        substring.dedup_substrings(docs_of([]), window=13, block_words=8)


# --- SimHash -------------------------------------------------------------------------------------


def brute_print(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = W.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_corpus():
    r = random.Random(3)
    base = [f"w{r.randint(0, 999)}" for _ in range(400)]
    texts = list(TEXTS)
    for _ in range(40):
        v = list(base)
        v[r.randrange(400)] = f"edit{r.randint(0, 99)}"
        texts.append(" ".join(v))
    return texts


def test_simhash_components(docs_of):
    texts = near_corpus()
    rows = [*((i + 5, t) for i, t in enumerate(texts)), (2, texts[-1]), (7, texts[2]), (None, texts[0])]
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs_of(rows, ("fp", "component_id"))).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    own = {f: f for _, f in prints}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in own:
        for b in own:
            if (a ^ b).bit_count() <= 4:
                own[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == {(i, signed(f)): least[find(f)] for i, f in prints}
    assert len(set(got.values())) < len(rows) - 35
    kept = [r.doc_id for r in simhash.one_of_each(docs_of([*rows, (6, "another"), (6, texts[1])])).collect()]
    assert sorted(kept, key=str) == sorted([*set(least.values()), None], key=str)
    assert {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs_of(rows), salts=1).collect()} == got


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_links_for_any_number_of_bits(spark, bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, bits + 1))) for b in base for _ in range(4)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long")
    near = [{f for f in prints if (f ^ g).bit_count() <= bits} for g in prints]
    own = {f: f for f in prints}
    for _ in prints:
        own = {f: min(own[x] for x in n) for f, n in zip(prints, near, strict=True)}
    edges = simhash.links(nodes, bits).collect()
    got = {f: f for f in prints}
    for _ in prints:
        for e in edges:
            u, v = e.u % (1 << 64), e.v % (1 << 64)
            got[u] = got[v] = min(got[u], got[v])
    assert got == own and sum(a != b for a, b in got.items()) > (10 if bits else -1)


def test_simhash_of_nothing(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    got = simhash.near_duplicates(docs_of([None, "", " "])).collect()
    assert {(r.fp, r.component_id) for r in got} == {(0, 0)}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in components.components(e, Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# --- decontamination -----------------------------------------------------------------------------

ITEM = "A farmer named Maria sold 12 kg of apples for 30 dollars and then gave 12 kg to Peter before noon on that day."


def hits(docs_of, spark, texts, items=((1, ITEM),), **kw):
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contaminated(docs_of(texts), b, **kw).collect()}


def test_blocks_of_items_find_what_one_block_does(docs_of, spark):
    items = [(i, f"item number {i} of this benchmark speaks of word{i} and thing{i} at length") for i in range(9)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, f"before it {items[i][1]} and after" if i < 9 and i % 2 else f"a plain text {i}") for i in range(20)], ("place", "__place", "block", "a.b"))
    left = {n: sorted(r["doc_id"] for r in decontam.without_contaminated(docs, benchmark, block_bytes=n).collect()) for n in (8 << 20, 150)}
    assert left[150] == left[8 << 20] == [i for i in range(20) if i >= 9 or i % 2 == 0]


def test_templates(docs_of, spark):
    other = ITEM.replace("12", "75").replace("30", "44").replace("Maria", "Ines").replace("Peter", "Karl")
    mixed = ITEM.replace("12 kg of", "75 kg of")  # 12 becomes 75 in one place and stays 12 in the other
    texts = ["intro words here. " + ITEM + " and more", other.upper() if False else "x. " + other, mixed, "a farmer sold many apples to all of us and then went home", None, "", ITEM[: len(ITEM) // 4], "noise " * 2000 + ITEM]
    assert hits(docs_of, spark, texts) == {(0, 1): False, (1, 1): True, (7, 1): False}
    assert hits(docs_of, spark, texts, block_bytes=10) == {(0, 1): False, (1, 1): True, (7, 1): False}
    left = decontam.without_contaminated(docs_of(texts, ("item_id", "coverage")), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 6] and "coverage" in left.columns


def test_items_of_any_kind(docs_of, spark):
    items = [(1, None), (2, ""), (3, "too short"), (4, "six plain words stand in here"), (5, "six plain words stand in here"), (6, "1 2 3 4 5 6 7 8 9 10")]
    assert hits(docs_of, spark, ["say: six plain words stand in here now", "1 2 3 4 5 6 7 8 9 10"], items) == {(0, 4): False, (0, 5): False}
    assert hits(docs_of, spark, ["x"], []) == {} and hits(docs_of, spark, [], items) == {}


PEOPLE = "Maria has 12 apples and 7 pears. Peter has 30 apples and gives Maria some of them. How many apples does Maria have now?"


def test_names_in_any_case_and_place(docs_of, spark):
    other = ITEM.replace("12", "75").replace("30", "44").replace("Maria", "Ines").replace("Peter", "Karl")
    for text in (ITEM, other):
        cases = [text.upper(), text.lower(), text.title(), "they say " + text]
        assert hits(docs_of, spark, cases) == {(i, 1): text is other for i in range(4)}
    people = PEOPLE.replace("Maria", "Élodie").replace("Peter", "Örjan").replace("30", "41")
    cases = [people, "Intro " + people, people.upper(), people.lower()]
    assert hits(docs_of, spark, cases, [(1, PEOPLE)]) == {(i, 1): True for i in range(4)}
    assert hits(docs_of, spark, [people.upper()], [(1, people)]) == {(0, 1): False}


def test_numbers_and_names_of_several_tokens(docs_of, spark):
    def put(*pairs):
        text = ITEM
        for old, new in pairs:
            text = text.replace(old, new)
        return text

    texts = [
        put(("12", "1.5")),
        put(("12", "1.5"), ("30", "$7.25")),
        put(("12", "1,250"), ("30", "2/3")),
        put(("Maria", "Mary Ann"), ("Peter", "Jean Luc Karl"), ("12", "1.5")),
        put(("12", "-1.5"), ("30", "1.5")),
        put(("12 kg of", "-12 kg of")),
    ]
    assert hits(docs_of, spark, texts) == {(i, 1): True for i in range(5)}
    assert hits(docs_of, spark, ["1,", "5 " + ITEM, ".5", ITEM + "3."]) == {(1, 1): False, (3, 1): False}


def test_verbatim_items_without_a_template(docs_of, spark):
    items = [(1, "12 7 19 4 8 3 11 5 6 40"), (2, "7 + 5 = 12"), (3, "Anna, Bert, Cleo, Dora, Emil, Fritz, Gwen, Hugo and Ida"), (4, "Capital of Peru"), (5, "Which river crosses Lima and Callao?"), (6, "Ozymandias"), (7, "4 5 6"), (8, "???")]
    texts = [f"as seen {t} elsewhere" for _, t in items[:6]] + ["4 5 6 ???", "12 7 19 4 8 3 12 5 6 40", "the capital of Chile", "7 + 5"]
    assert hits(docs_of, spark, texts, items) == {(i, i + 1): False for i in range(6)}


@pytest.mark.parametrize("n", [45, 60, 400])
def test_a_run_of_a_long_item(docs_of, spark, n):
    r = random.Random(n)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) + ("7" if i % 5 == 0 else "") for i in range(n)]
    run = lambda k, at: "so " + " ".join(words[at : at + k]) + " it goes"
    texts = [run(25, 3), run(13, 20), run(13, 0).upper(), run(13, n - 13), run(12, 20), " ".join(words[:8] + ["x"] + words[9:17] + ["y"] + words[18:20])]
    assert hits(docs_of, spark, texts, [(1, " ".join(words))]) == {(i, 1): False for i in range(4)}
    # Slots that contradict each other around a long run.
    other = " ".join("12" if w == words[0] else w for w in words[:5]) + " " + " ".join(words[5:31] + ["12" if w[-1] == "7" else w for w in words[31:]])
    assert hits(docs_of, spark, [other], [(1, " ".join(words))]) == {(0, 1): False}


def brute_contaminated(doc, item, coverage=0.5, window=8):
    """The rule for texts of lower-case words, where a template is the text itself."""
    d, t = doc.split(), item.split()
    w = min(window, len(t))
    if not w:
        return False
    total = len(t) - w + 1
    at = {(p, i) for p in range(len(d) - w + 1) for i in range(total) if d[p : p + w] == t[i : i + w]}
    covered = {i for _, i in at}
    whole = {i + k for i in covered for k in range(w)}
    for g in {p - i for p, i in at}:
        mine = sorted(i for p, i in at if p - i == g)
        if len(mine) >= coverage * total:
            return True
        if len(t) >= 5 and len(covered) >= coverage * total and len({i + k for i in mine for k in range(w)}) >= coverage * len(whole):
            return True
        run = 1
        for a, b in zip(mine, [*mine[1:], -9], strict=True):
            if run + w - 1 >= 13:
                return True
            run = run + 1 if b == a + 1 else 1
    return False


def test_contamination_by_brute_force(docs_of, spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 4, 5, 7, 8, 9, 12, 14, 20, 26, 40, 60, 61])]
    texts = []
    for _ in range(240):
        words = r.choice(items)[1].split()
        a = r.randrange(len(words))
        part = words[a : a + r.randint(1, len(words))]
        if r.random() < 0.4:
            part = [r.choice(vocab) if r.random() < 0.08 else w for w in part]
        if r.random() < 0.3:
            part = part[: len(part) // 2] + say(3).split() + part[len(part) // 2 :]
        texts.append(" ".join([say(r.randint(0, 12)), *part, say(r.randint(0, 12))]))
    texts += ["", None, say(3000)]
    got = set(hits(docs_of, spark, texts, items))
    want = {(k, i) for k, t in enumerate(texts) for i, item in items if t and brute_contaminated(t, item)}
    assert got == want and 50 < len(want)
    assert set(hits(docs_of, spark, texts, items, block_bytes=300)) == want


PROBLEMS = (
    "{A} has {n} apples and buys {m} more at the market. If {A} gives {k} of them to {B}, how many apples are left?",
    "A train leaves the station at {n} km per hour. {A} boards {m} minutes later and rides for {k} hours. How far does {A} travel?",
    "{A} and {B} share {n} dollars so that {A} gets {m} dollars more. How much money does {B} get in the end?",
    "In a school of {n} pupils, {m} percent play chess. {A} counts {k} new players. How many pupils play chess now?",
    "{A} reads {n} pages a day for {m} days and then {k} pages on the last day. How long is the book that {A} reads?",
    "A tank holds {n} litres of water. {A} pours out {m} litres each minute for {k} minutes. How much water is left in the tank?",
)


def test_recall_of_changed_questions(docs_of, spark):
    """The share of questions with other numbers, names and units that are found."""
    r = random.Random(6)
    names = ["Maria", "Peter", "Ines", "Karl", "Anna", "Tom", "Olga", "Yusuf", "Chen", "Mary Ann", "Élodie"]
    units = {"km": "miles", "minutes": "hours", "dollars": "euros", "litres": "kg", "percent": "percent", "hours": "minutes"}

    def fill(t, decimals=False):
        a, b = r.sample(names[:9], 2)
        number = lambda: f"{r.randint(2, 900)}.{r.randint(1, 9)}" if decimals and r.random() < 0.5 else str(r.randint(2, 9000))
        return t.format(A=a, B=b, n=number(), m=number(), k=number())

    items = [(i, fill(t)) for i, t in enumerate(PROBLEMS)]
    kinds = {"numbers": [], "names": [], "both": [], "decimals": [], "units": []}
    for i, t in enumerate(PROBLEMS):
        for _ in range(10):
            kinds["both"].append((i, fill(t)))
            kinds["decimals"].append((i, fill(t, True)))
            kinds["numbers"].append((i, re.sub(r"\d+", lambda _: str(r.randint(2, 9000)), items[i][1])))
            old = sorted({n for n in names[:9] if n in items[i][1]})
            new = dict(zip(old, r.sample([n for n in names if n not in old], len(old)), strict=True))
            kinds["names"].append((i, re.sub("|".join(old), lambda m: new[m[0]], items[i][1])))
            kinds["units"].append((i, re.sub("|".join(units), lambda m: units[m[0]], re.sub(r"\d+", lambda _: str(r.randint(2, 9000)), items[i][1]))))
    flat = [(kind, i, f"some words before it. {t} And a few after it.") for kind, rows in kinds.items() for i, t in rows]
    found = set(hits(docs_of, spark, [t for _, _, t in flat], items))
    share = {kind: sum((n, i) in found for n, (k, i, _) in enumerate(flat) if k == kind) / len(rows) for kind, rows in kinds.items()}
    print(share)
    assert min(share.values()) >= 0.9, share
    assert all(flat[n][1] == i for n, i in found)  # and no question is taken for another


# --- mixing --------------------------------------------------------------------------------------


def mixed(docs_of, rows, **kw):
    df = docs_of([]).sparkSession.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    return mixing.Mix(df, **kw)


def test_mix_meets_targets_and_caps(docs_of):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", None, "é", "tiny"] if i % 50 else ["tiny"]), "w " * r.randint(0, 90)) for i in range(400)] + [(7, "a", "w " * 40)] * 3 + [(None, "a", None)]
    for slots in (50, 5000):
        m = mixed(docs_of, rows, slots=slots)
        got = m.taken().collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for x in got:
            by[x.source].append(x)
            assert 0 <= x.taken <= 3 * x.size
        order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
        sizes = [sum(x.size for x in by[s]) for s in order]
        for s, size, target in zip(order, sizes, mixing.water_level(sizes, [5, 2, 1, 5, 2][: len(order)], 3), strict=True):
            assert {x.source_size for x in by[s]} == {size} and {x.target for x in by[s]} == {target}
            assert abs(sum(x.taken for x in by[s]) - target) <= 0.5
    again = mixed(docs_of, rows, slots=5000).taken().collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_schedule_is_whole_and_interleaved(docs_of):
    rows = [(i, "abc"[i % 3], "w " * 20) for i in range(300)]
    m = mixed(docs_of, rows, slots=600)
    p = m.pieces().collect()
    taken = m.taken().agg(F.sum("taken")).first()[0]
    assert sum(x.words for x in p) == taken and min(x.words for x in p) > 0
    slots = sorted({(x.slot, x.sid) for x in p})
    early = Counter(s for _, s in slots[: len(slots) // 4])
    assert max(abs(early[s] / (len(slots) // 4) - c / len(slots)) for s, c in Counter(s for _, s in slots).items()) < 0.03


def test_mix_of_nothing(docs_of):
    assert mixed(docs_of, []).taken().count() == 0
    assert [x.taken for x in mixed(docs_of, [(1, None, None)]).taken().collect()] == [0]
    with pytest.raises(ValueError):  # more slots than points are told apart
        mixed(docs_of, [(1, "a", "x " * 9)], block_words=1e-9)


def brute_mix(rows, slots, block_words):
    """The schedule slot by slot: taken words, first slot and won slots of every row, by (source, place)."""
    sized = [(i, s, len(W.findall(t or ""))) for i, s, t in rows]
    names = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = [sum(n for _, s, n in sized if s == name) for name in names]
    targets = mixing.water_level(size, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    take = [min(int(t + 0.5), 3 * n) for t, n in zip(targets, size, strict=True)]
    block = min(block_words, max(1, math.ceil(sum(size) / slots)))
    share = [max(2, math.ceil(t / block)) if t else 0 for t in take]
    phi, edges = (mixing.PHI_HIGH << 31) + mixing.PHI_LOW, [sum(share[:k]) for k in range(len(share) + 1)]
    won = [[] for _ in names]
    for slot in range(1, edges[-1] + 1):
        u = slot * phi % (1 << 62)
        won[next(k for k in range(len(names)) if (edges[k] << 62) // edges[-1] <= u < (edges[k + 1] << 62) // edges[-1])].append(slot)
    out = []
    for k, name in enumerate(names):
        mine = sorted((r for r in sized if r[1] == name), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        owner = [place for place, r in enumerate(mine) for _ in range(r[2])]
        words, first = Counter(), {}
        at = 0
        for n, slot in enumerate(won[k]):
            for _ in range(take[k] // len(won[k]) + (n < take[k] % len(won[k]))):
                place = owner[at % len(owner)]
                words[place] += 1
                first[place] = min(slot, first.get(place, slot))
                at += 1
        out += [(r[0], name, r[2], words[place], first.get(place), len(won[k])) for place, r in enumerate(mine)]
    return Counter(out)


@pytest.mark.parametrize(("slots", "block_words"), [(1 << 17, 1 << 14), (40, 1 << 14), (1 << 17, 3)])
def test_the_slots_decide_the_mix(docs_of, slots, block_words):
    r = random.Random(7)
    rows = [(i, r.choice(["a", "b", None, "é"]), "w " * r.randint(0, 30)) for i in range(90)] + [(500, "one", "w"), (501, "none", ""), (None, "a", "w w")]
    got = mixed(docs_of, rows, slots=slots, block_words=block_words).taken().collect()
    assert Counter((x.doc_id, x.source, x.size, x.taken, x.first_slot, x.source_slots) for x in got) == brute_mix(rows, slots, block_words)
    # A schedule of other points takes other blocks first.
    assert len({x.first_slot for x in got}) > 30 or slots == 40


def test_mix_of_many_sources(docs_of):
    got = mixed(docs_of, [(i, f"s{i:04}", "w " * (i % 7)) for i in range(3000)]).taken().collect()
    assert len(got) == 3000 and all(x.taken <= 3 * x.size for x in got)
    assert sum(x.taken for x in got) == pytest.approx(sum(x.size for x in got), abs=1500)


# --- top-k ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "shard"), [(4096, 4096), (2, 7)])
def test_top_k(spark, block, shard):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8).round(1)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(50, rows[3][1]), (300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [1.0, 2.0]), (305, [0.5, 2.0]), (None, rows[1][1]), (350, [1e12] * 8), (306, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    v = topk.quantised(df)
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(v, v.where("vec_id % 50 = 0 or vec_id = 304"), query_block=block, shard_rows=shard).collect()}
    ok = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = {}
    for q in sorted({i for i, _ in ok if i % 50 == 0 or i == 304}):
        vec = min(e for i, e in ok if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(vec, e, strict=True)), i) for i, e in ok if i != q and len(e) == len(vec)))
        for n, (s, i) in enumerate(scored[:5], 1):
            want[(q, n)] = (i, -s)
    assert got == want


def test_the_cutoff_saves_products(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(8, 32))
    rows = [(i, [float(x) for x in centre[i % 8] * 4 + r.normal(size=32) * 0.1]) for i in range(1600)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    tally = spark.sparkContext.accumulator(0)
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), tally=tally).collect()
    e = np.array([[math.floor(256 * x) for x in x] for _, x in rows])
    score = e[::50] @ e.T
    for n, q in enumerate(range(0, 1600, 50)):
        score[n, q] = -(2**62)
        want = sorted(range(1600), key=lambda i: (-score[n, i], i))[:5]
        assert [(x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == [(i, score[n, i]) for i in want]
    assert 0 < tally.value < 0.5 * 4 * 32 * 1600


@pytest.mark.parametrize("scale", [1, 1 << 27])
def test_sufficient_entries(scale):
    r = np.random.default_rng(3)
    q, m = (r.integers(-99, 99, (n, 10)) * scale for n in (6, 300))
    q, m = topk._exactly(q.astype(float), m.astype(float))
    assert (q.dtype == object) == (scale > 1)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in m] for x in q], object)
    for cut in (0, 20_000, 60_000):
        skip = np.arange(300)[None, :] == np.arange(6)[:, None]
        row, col, score, _ = topk._sufficient(q, m, np.array([[cut * scale * scale]] * 6, q.dtype), 3, skip)
        want = {(i, j, exact[i, j]) for i in range(6) for j in range(300) if i != j and exact[i, j] >= cut * scale * scale}
        assert {(int(i), int(j), int(s)) for i, j, s in zip(row, col, score, strict=True)} == want


def test_top_k_of_nothing(spark):
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


# --- tokens, language, quality -------------------------------------------------------------------


def test_token_counts(docs_of):
    pytest.importorskip("tiktoken")
    try:
        lengths = tokens.token_lengths(docs_of(TEXTS))
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    n = [r.n_tokens for r in lengths.orderBy("doc_id").collect()]
    assert len(n) == len(TEXTS) and n[TEXTS.index(None)] == 0 and n[TEXTS.index("")] == 0 and n[TEXTS.index("short")] >= 1
    t = tokens.context_table(tokens.length_histogram(lengths), block=16).cache()
    for r in t.collect():
        L = r.n_tokens
        assert (r.n_docs, r.docs_ge, r.docs_le, r.tokens_ge, r.truncated_tokens) == (n.count(L), sum(x >= L for x in n), sum(x <= L for x in n), sum(x for x in n if x >= L), sum(min(x, L) for x in n))
    assert tuple(tokens.total(t).first()) == (len(n), sum(n)) and tokens.truncated_total(t, 77).first()[0] == sum(min(x, 77) for x in n)
    for q in (0.01, 0.5, 0.9, 1.0):
        assert tokens.quantile(t, q).first()[0] == sorted(n)[math.ceil(q * len(n)) - 1]
    assert tokens.context_table(tokens.length_histogram(tokens.token_lengths(docs_of([])))).count() == 0


def brute_encode(text, ranks):
    """Byte-pair merges in order of rank, piece by piece."""
    import regex

    out = []
    for piece in regex.findall(tokens.PATTERN, text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_lengths_by_brute_force(docs_of):
    pytest.importorskip("tiktoken")
    pytest.importorskip("regex")
    try:
        lines = open(tokens.DEFAULT_VOCABULARY, "rb").read().splitlines()
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    texts = [*TEXTS[:30], None, "", "it's 2024, isn't it?\n\n  naïve 日本語 <|endoftext|>", "x" * 300]
    got = {r.doc_id: r.n_tokens for r in tokens.token_lengths(docs_of(texts)).collect()}
    assert got == {i: len(brute_encode(t or "", ranks)) for i, t in enumerate(texts)}


def test_encoding_round_trip():
    tiktoken = pytest.importorskip("tiktoken")
    try:
        raw = open(tokens.DEFAULT_VOCABULARY, "rb").read()
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    e = tokens._encoder(raw)
    assert isinstance(e, tiktoken.Encoding)
    for t in ("a b  c\n\n", "<|endoftext|> don't", "日本語 é 123"):
        assert e.decode(e.encode_ordinary(t)) == t


def test_language(docs_of, spark):
    r = random.Random(2)
    vocab = {"en": ["the", "and", "with", "shine", "thing", "water"], "de": ["und", "der", "nicht", "schön", "über", "zeit"], "fr": ["et", "les", "être", "voilà", "peu", "eaux"]}
    rows = []
    for i in range(240):
        lang = r.choice(list(vocab))
        rows.append((i, " ".join(r.choice(vocab[lang]) for _ in range(r.randint(3, 60))), lang if i % 7 else None, "s", 0))
    odd = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !!!", "fr", "s", 0), (903, "木", None, "s", 0), (904, "zqx " * 400, None, "s", 0), (905, "the " * 40_000, None, "s", 0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    m = langid.fit(df.where("doc_id < 240"), per_language=30)
    assert set(m.labels) == set(vocab) and len(m.labels) <= 9
    got = {x.doc_id: x for x in langid.predict(df, m).collect()}
    known = [x for x in rows if x[2]]
    assert sum(got[x[0]].lang_pred == x[2] for x in known) >= 0.98 * len(known) and not any(got[x[0]].rejected for x in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred in vocab and got[904].rejected and got[905].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in got.values())
    none = langid.fit(df.where("doc_id < 0"))
    assert {(x.lang_pred, x.rejected) for x in langid.predict(df, none).collect()} == {("und", False)} and langid.predict(df.limit(0), m).count() == 0


def brute_language(model, text):
    """The nearest centroid by dictionaries of n-grams; None: no letter."""
    folded = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in (text or "").encode())
    counts = Counter()
    for k in (2, 3):
        for i in range(len(folded) - k + 1):
            g = folded[i : i + k]
            if g.strip(b" "):
                code = (int.from_bytes(g, "big") + (k << 24)) * 2654435761 % 2**32
                counts[(code >> 16) % len(model.idf)] += 1
    if not any(c.isalpha() for c in text or ""):
        return None
    x = {i: math.log1p(n) * float(model.idf[i]) for i, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    sims = [sum(v * float(c[i]) for i, v in x.items()) / norm for c in model.centroids]
    best = max(range(len(sims)), key=lambda j: sims[j])
    return model.labels[best], sims[best], sims[best] < model.reject_below[best] * math.sqrt(min(1, sum(counts.values()) / model.full))


def test_language_by_brute_force(docs_of):
    df = docs_of([*TEXTS, "Ünïcode ßtraße " * 40, "木 木"]).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "aa").when(F.col("doc_id") % 3 == 1, "bb"))
    m = langid.fit(df, per_language=20)
    for r in langid.predict(df, m).collect():
        want = brute_language(m, r.text)
        if want is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == want[0] and r.score == pytest.approx(want[1], abs=1e-5) and r.rejected == want[2]


def test_long_texts_are_counted_in_pieces():
    from quillmere.llm import textkit as tk

    import pyarrow as pa

    c = next(tk.chunks(pa.array(["ab cd " * 50 + "xyz", "", "q"])))
    whole = langid.ngram_counts(c, 512)
    for piece in (1, 7, 100):
        assert (langid.ngram_counts(c, 512, piece) == whole).all()


def test_repeated_labelled_rows_stay_bounded(docs_of):
    df = docs_of([(7, "the same text")] * 500 + [(None, "no id")] * 300).withColumn("lang", F.lit("xx"))
    assert langid.fit(df, per_language=20).labels
    assert langid.fit(df.withColumn("lang", F.concat(F.lit("l"), (F.monotonically_increasing_id() % 7).cast("string"))), max_languages=3).labels[::3] != []


def brute_weights(rows, target, slots):
    """log weights by counting n-grams in dictionaries; the slot of an n-gram is the operator's."""
    from quillmere.llm import textkit as tk

    import pyarrow as pa

    def grams(t):
        out = Counter()
        for c in tk.chunks(pa.array([t or ""])):
            w = W.findall(t or "")
            at, _ = quality.ngram_slots(c, slots)
            assert len(at) == 2 * len(w) - 1 if w else not len(at)
            out.update(at.tolist())
        return out

    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in target:
            good.update(grams(t))
    ratio = [math.log((good[s] + 1) / (sum(good.values()) + slots)) - math.log((raw[s] + 1) / (sum(raw.values()) + slots)) for s in range(slots)]
    return [sum(n * ratio[s] for s, n in grams(t).items()) for _, t in rows]


def test_resampling_by_brute_force(docs_of, spark):
    rows = [*enumerate(TEXTS), (4, "another text of an id"), (None, TEXTS[3])]
    target = {2, 4, 8, 16, 32, 66}
    got = quality.importance_resample(docs_of(rows, ("log_weight", "selected")), spark.createDataFrame([(i,) for i in target], "doc_id long"), fraction=0.3, slots=400).collect()
    want = brute_weights(rows, target, 400)
    by = lambda xs: sorted(xs, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for g, (i, w) in zip(by([(x.doc_id, x.log_weight) for x in got]), by([(i, w) for (i, _), w in zip(rows, want, strict=True)]), strict=True):
        assert g[0] == i and g[1] == pytest.approx(w, abs=1e-6)
    k = int(0.3 * len(rows))
    order = sorted(got, key=lambda x: (-x.resample_key, x.doc_id is not None, x.doc_id or 0))
    assert sorted(x.resample_key for x in got if x.selected) == sorted(x.resample_key for x in order[:k])
    # The noise is Gumbel: its mean over many ids is Euler's constant.
    noise = quality.importance_resample(docs_of([""] * 4000), spark.createDataFrame([(1,)], "doc_id long"), slots=10).agg(F.avg("resample_key"), F.stddev("resample_key")).first()
    assert noise[0] == pytest.approx(0.5772, abs=0.08) and noise[1] == pytest.approx(math.pi / math.sqrt(6), abs=0.08)


def test_resampling(docs_of, spark):
    r = random.Random(4)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["spam", "click", "win", "cash"]
    texts = [" ".join(r.choice(good if i % 2 else bad) for _ in range(r.randint(2, 30))) for i in range(200)] + [None, "", "x " * 20_000]
    rows = [*enumerate(texts), (5, texts[5])]
    target = spark.createDataFrame([(i,) for i in range(1, 100, 2)] + [(None,), (1,)], "doc_id long")
    got = quality.importance_resample(docs_of(rows, ("selected",)), target, fraction=0.5, slots=500).collect()
    assert len(got) == len(rows) and sum(x.selected for x in got) == len(rows) // 2
    by = {x.doc_id: x for x in got}
    low = max(x.resample_key for x in got if not x.selected)
    assert all(x.resample_key >= low for x in got if x.selected)
    assert sum(by[i].selected for i in range(1, 200, 2)) > 90 and by[200].log_weight == 0 and by[201].n_grams == 0
    assert quality.importance_resample(docs_of([]), target).count() == 0


def test_top_by_key_of_equal_rows(spark):
    df = spark.createDataFrame([(i % 2 if i % 5 else None, 1.5) for i in range(60)], "doc_id long, k double")
    for k in (0, 1, 12, 13, 36, 37, 59, 60):
        got = quality.top_by_key(df, "k", "doc_id", k, bins=4, small=1).where("selected").collect()
        assert sorted((x.doc_id for x in got), key=str) == sorted(sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x or 0))[:k], key=str)


def test_top_by_key_with_ties(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(40)] + [(3, 3.0)], "doc_id long, k double")
    for k in (0, 1, 11, 12, 25, 41, 50):
        got = quality.top_by_key(df, "k", "doc_id", k, bins=2, small=1).where("selected").collect()
        want = sorted([(-float(i % 4), i) for i in range(40)] + [(-3.0, 3)])[:k]
        assert sorted((-x.k, x.doc_id) for x in got) == want


def test_digests(docs_of):
    d = docs_of(["abc"]).select(F.sha2(F.col("text").cast("binary"), 256)).first()[0]
    assert d == hashlib.sha256(b"abc").hexdigest()
