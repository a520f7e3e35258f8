"""Benchmark decontamination by template canonicalisation.

Tokens are canonicalised: a token with a digit, a unit after a number, and a capitalised token
become typed placeholders; other tokens stay, lower-cased. Windows of template tokens are
hash-joined with those of the benchmark, in three ways: with capitals inside a sentence as names,
with capitals anywhere, and whatever the document's case, with wildcards where the item has names
or with every token as it is. For every matched item the values that the
document puts into the item's slots must be consistent: one value of the item goes with one
value of the document and back. So a question with other numbers or names is caught, and a
chance match of placeholders is not.

The benchmark's texts are broadcast in blocks of at most about ``block_bytes``, one pass over the
documents for each block, so what the driver gathers and what is broadcast does not grow with the
benchmark. Each Python worker builds the windows of a block once and keeps those of one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import Workspace, aside

#: Units that make a placeholder after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "g", "kg", "mg", "lb", "oz", "t", "l", "ml", "s", "ms", "min", "h", "hr", "hrs", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres", "mile", "miles", "degree", "degrees", "watt", "watts", "volt", "volts", "usd", "eur", "kw", "kwh", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb")
NUMBER, NAME, UNIT = 1, 2, 3
#: Consecutive tokens that identify an item whatever its length, and whatever they are.
RUN = 13

_TABLE = tk.byte_table(23)
_TOKEN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"|"]] = True
_INNER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_INNER[[ord(c) for c in ".,/:"]] = True
_SIGN[[ord(c) for c in "+-"]] = True
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_PLACE = tk.mix(np.arange(4, dtype=np.uint64) + np.uint64(0x51ED270B))


def _cases() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below 65536: is it upper case; its lower case where UTF-8 keeps the length."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(1 << 16)]
    upper = np.array([c.isupper() or c.istitle() for c in chars])
    lower = np.arange(1 << 16)
    for c in np.flatnonzero(upper):
        low = chars[c].lower()
        if len(low) == 1 and len(low.encode()) == len(chars[c].encode()):
            lower[c] = ord(low)
    return upper, lower


_UPPER, _LOWER = _cases()


def _folded(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and the length in bytes of the capital that starts at each place (0: none)."""
    out = tk.LOWER[d]
    capital = _CAPITAL[d].astype(np.uint8)
    for size, least, most in ((2, 0xC3, 0xDF), (3, 0xE1, 0xEF)):
        at = np.flatnonzero((d >= least) & (d <= most))
        at = at[at + size <= len(d)]
        c = d[at].astype(np.int64) & (31 if size == 2 else 15)
        for j in range(1, size):
            c = c << 6 | d[at + j] & 63
        at, c = at[_UPPER[c]], c[_UPPER[c]]
        capital[at] = size
        c = _LOWER[c]
        for j in range(size - 1, 0, -1):
            out[at + j] = 0x80 | c & 63
            c = c >> 6
        out[at] = c | (0xC0 if size == 2 else 0xE0)
    return out, capital


def _token_bytes(d: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bytes of tokens: letters and digits, and . , / : between two digits of one document."""
    mask = _TOKEN[d]
    at = np.flatnonzero(_INNER[d[1:-1]]) + 1 if len(d) > 2 else np.empty(0, np.int64)
    at = at[_DIGIT[d[at - 1]] & _DIGIT[d[at + 1]]]
    edge = np.zeros(len(d) + 1, bool)
    edge[bounds] = True
    mask[at[~edge[at] & ~edge[at + 1]]] = True
    return mask


class View:
    """Template tokens: literal hash, kind (0: literal), template id, document."""

    def __init__(self, literal: np.ndarray, kind: np.ndarray, doc: np.ndarray):
        self.literal, self.kind, self.doc = literal, kind, doc
        self.template = np.where(kind == 0, literal, _PLACE[kind])

    def windows(self, w: int, least_literal: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of windows of w tokens in one document with enough literals."""
        h = _rolled(self.template, w)
        if not len(h):
            return np.empty(0, np.int64), h
        lit = np.concatenate([[0], np.cumsum(self.kind == 0)])
        ok = (self.doc[: len(h)] == self.doc[w - 1 :]) & (lit[w : w + len(h)] - lit[: len(h)] >= least_literal)
        at = np.flatnonzero(ok)
        return at, h[at]


class Tokens(View):
    """Tokens of a chunk; a number with inner marks is one. ``kind`` takes capitals inside a sentence for names, ``view``
    any capitals, and ``plain`` none."""

    def __init__(self, chunk: tk.Chunk):
        d = chunk.data
        starts, ends, doc = tk.runs(_token_bytes(d, chunk.bounds), chunk.bounds)
        low, capital = _folded(d)
        literal = tk.span_hash(tk.prefix(_TABLE[low]), starts, ends)
        n = len(starts)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[d])])
        number = digits[ends] > digits[starts]
        stops = np.concatenate([[0], np.cumsum(_STOP[d])])
        follows = np.zeros(n, bool)
        unit = np.zeros(n, bool)
        gap_clean = np.zeros(n, bool)
        commas = np.concatenate([[0], np.cumsum((d == ord(",")) | (d == ord(";")) | (d == ord("(")) | (d == ord(")")))])
        if n > 1:
            follows[1:] = doc[1:] == doc[:-1]
            gap_clean[1:] = follows[1:] & (stops[starts[1:]] == stops[ends[:-1]])
            after = np.flatnonzero(number[:-1] & follows[1:]) + 1
            unit[after] = np.isin(literal[after], _unit_hashes())
        size = capital[starts] if n else np.zeros(0, np.uint8)
        self.capital = (size > 0) & (ends - starts > size)
        self.plain = np.where(number, NUMBER, np.where(unit, UNIT, 0))
        self.joined = np.zeros(n, bool)
        if n > 1:
            self.joined[1:] = gap_clean[1:] & (commas[starts[1:]] == commas[ends[:-1]])
        super().__init__(literal, self._named(self.capital & gap_clean), doc)
        # The value of a number has its sign, which is no byte of the token.
        before = np.maximum(starts - 1, 0)
        signed = number & _SIGN[d[before]] & (starts > chunk.bounds[doc]) if n else number
        signed &= (before == chunk.bounds[doc]) | ~_TOKEN[d[np.maximum(before - 1, 0)]]
        self.value = np.where(signed, tk.mix(literal ^ d[before] if n else literal), literal)

    def _named(self, name: np.ndarray) -> np.ndarray:
        return np.where((self.plain == 0) & name, NAME, self.plain)

    def views(self) -> list[View]:
        """By capitals inside a sentence, and by capitals anywhere; a name of several tokens is one."""
        return [self._merged(k) for k in (self.kind, self._named(self.capital))]

    def _merged(self, kind: np.ndarray) -> View:
        more = np.zeros(len(kind), bool)
        more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & self.joined[1:]
        if not len(kind):
            return View(self.value, kind, self.doc)
        first = np.flatnonzero(~more)
        size = np.diff(np.concatenate([first, [len(kind)]]))
        value = np.where(size > 1, tk.span_hash(tk.prefix(self.literal), first, first + size), self.value[first])
        return View(value, kind[first], self.doc[first])


def _rolled(values: np.ndarray, w: int) -> np.ndarray:
    """Unmixed hashes of all windows of w values: the sums of value times radix**place."""
    pre = tk.prefix(values)
    n = len(pre) - w
    return (pre[w:] - pre[:n]) * tk.powers(len(pre))[1][:n] if n > 0 else np.empty(0, np.uint64)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        data = np.frombuffer("".join(UNITS).encode(), np.uint8)
        ends = np.cumsum([len(u) for u in UNITS])
        _units.append(np.sort(tk.span_hash(tk.prefix(_TABLE[data]), ends - [len(u) for u in UNITS], ends)))
    return _units[0]


#: Kinds of hashes: windows of the two views, windows of the plain index, and first and second halves of its masked ones.
VIEWS, WHOLE, FIRST, SECOND = (1, 2), 4, 8, 16


class Seen:
    """The kinds of hashes that an index holds, by their top bits: most windows of a document need no search."""

    def __init__(self, marks: list[tuple[int, np.ndarray]]):
        bits = min(26, max(12, (8 * sum(len(h) for _, h in marks)).bit_length()))
        self.shift, self.table = np.uint64(64 - bits), np.zeros(1 << bits, np.uint8)
        for kind, h in marks:
            self.table[h >> self.shift] |= kind

    def kinds(self, h: np.ndarray) -> np.ndarray:
        return self.table[h >> self.shift]

    def holds(self, h: np.ndarray, kind: int) -> np.ndarray:
        return self.kinds(h) & kind > 0


class ViewIndex:
    """Template windows of some items in one view, sorted by hash, for each window length."""

    def __init__(self, view: View, n: int, window: int, shortest: int):
        self.view = view
        count = tk.counts_by_doc(view.doc, n)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.total = np.zeros(n, np.int64)
        for w in range(shortest, window + 1):
            at, h = _own(view, count, w, window, *view.windows(w, _literals(w)))
            if len(at):
                self.by[w] = _sorted(at, h)
                self.total += tk.counts_by_doc(view.doc[at], n)


class PlainIndex:
    """Windows of some items that don't hang on the case of a document: of all tokens as they are,
    and with wildcards (bits of the mask) where the item has names."""

    def __init__(self, t: Tokens, n: int, window: int, shortest: int, left_out: np.ndarray):
        self.view, self.value = View(t.literal, t._named(t.capital), t.doc), t.value
        count = tk.counts_by_doc(t.doc, n)
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.masked: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.total_exact, self.total_masked = np.zeros(n, np.int64), np.zeros(n, np.int64)
        name = (self.view.kind == NAME).astype(np.int64)
        every = View(t.literal, np.zeros_like(t.plain), t.doc)
        for w in range(1, window + 1):
            at, h = _own(t, count, w, window, *every.windows(w, 0))
            at, h = at[~left_out[t.doc[at]]], h[~left_out[t.doc[at]]]
            if len(at):
                self.exact[w] = _sorted(at, h)
                self.total_exact += tk.counts_by_doc(t.doc[at], n)
            if w < shortest:
                continue
            at, h = _own(t, count, w, window, *self.view.windows(w, _literals(w)))
            self.total_masked += tk.counts_by_doc(t.doc[at], n)
            mask = sum((name[at + j] << j for j in range(w)), np.zeros(len(at), np.int64))
            for m in np.unique(mask):
                self.masked[w, int(m)] = _sorted(at[mask == m], h[mask == m])

    def marks(self) -> Iterator[tuple[int, np.ndarray]]:
        for h, _ in [*self.exact.values(), *self.masked.values()]:
            yield WHOLE, h
        for w in {w for w, _ in self.masked}:
            half = _rolled(self.view.template, w - w // 2)
            at = np.concatenate([at for (v, _), (_, at) in self.masked.items() if v == w])
            yield FIRST, half[at]
            yield SECOND, half[at + w // 2]

    def hits(self, t: Tokens, seen: Seen) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        """Places in the document and in the item of equal windows, their length, and whether they are exact.

        A mask is tried only at the places where both halves of a window (of odd length they share a token)
        are halves of items' windows with the same wildcards. So every place is hashed once for each mask of
        a half, at most 16 for 8 tokens, and not for each mask of a window."""
        for w, entry in self.exact.items():
            h = _rolled(t.literal, w)
            pos = np.flatnonzero(seen.holds(h, WHOLE))
            yield *_found(entry, t, pos, h[pos], w), w, True
        values = np.where(t.plain == 0, t.literal, _PLACE[t.plain])
        wild, p = values - _PLACE[NAME], tk.powers(9)[0]
        for w in {w for w, _ in self.masked}:
            entries = {m: entry for (v, m), entry in self.masked.items() if v == w}
            whole, half, low = _rolled(values, w), _rolled(values, w - w // 2), (1 << w - w // 2) - 1
            kinds = {}
            for m in {m & low for m in entries} | {m >> w // 2 for m in entries}:
                h = half.copy()
                for j in _bits(m):
                    h -= wild[j : j + len(h)] * p[j]
                kinds[m] = seen.kinds(h)
            starts = {m: np.flatnonzero(kinds[m][: len(whole)] & FIRST > 0) for m in {m & low for m in entries}}
            for m, entry in entries.items():
                pos = starts[m & low]
                pos = pos[kinds[m >> w // 2][pos + w // 2] & SECOND > 0]
                h = whole[pos]
                for j in _bits(m):
                    h -= wild[pos + j] * p[j]
                ok = seen.holds(h, WHOLE)
                yield *_found(entry, t, pos[ok], h[ok], w), w, False


def _bits(mask: int) -> list[int]:
    return [j for j in range(mask.bit_length()) if mask >> j & 1]


def _found(entry: tuple[np.ndarray, np.ndarray], t: Tokens, pos: np.ndarray, h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``_joined`` for windows of w tokens of one document."""
    ok = t.doc[pos] == t.doc[pos + w - 1]
    return _joined(entry, pos[ok], h[ok])


def _own(view: View, count: np.ndarray, w: int, window: int, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of w tokens that stand for their item: a short item is one window."""
    own = count[view.doc[at]]
    mine = (own == w) if w < window else (own >= w)
    return at[mine], h[mine]


def _sorted(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(h, kind="stable")
    return h[o], at[o].astype(np.int32)


def _joined(entry: tuple[np.ndarray, np.ndarray], pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a place in the documents and one in the items with equal hashes."""
    hashes, at = entry
    lo = np.searchsorted(hashes, h, side="left")
    hit = np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == h))
    lo, n = lo[hit], np.searchsorted(hashes, h[hit], side="right") - lo[hit]
    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(pos[hit], n), at[k].astype(np.int64)


def _counts_up(text: str) -> bool:
    """Is the text a short count, as 1 2 3 4, which stands in lists everywhere?"""
    words = re.findall(r"\w+", text[:200])
    if not 1 < len(words) < RUN or len(text) > 200 or not all(w.isascii() and w.isdecimal() for w in words):
        return False
    return all(int(b) - int(a) == 1 for a, b in zip(words[:-1], words[1:], strict=True))


class Index:
    """The windows of some benchmark items in each view."""

    def __init__(self, items: list[tuple[int, str]], window: int, shortest: int):
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        parts = list(tk.chunks(texts, 1 << 62))
        self.views, self.plain, self.seen = [], None, None
        if parts:
            t = Tokens(parts[0])
            self.views = [ViewIndex(v, len(items), window, shortest) for v in t.views()]
            self.plain = PlainIndex(t, len(items), window, shortest, np.array([_counts_up(x or "") for _, x in items]))
            self.seen = Seen([*((kind, h) for kind, v in zip(VIEWS, self.views, strict=True) for h, _ in v.by.values()), *self.plain.marks()])


def _literals(w: int) -> int:
    return (w + 1) // 2


def _consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Each value of one side goes with one value of the other, both ways."""
    if not len(a):
        return True
    pairs = np.unique(np.stack([a, b]), axis=1)
    return pairs.shape[1] == len(np.unique(a)) == len(np.unique(b))


def _matches(index: Index, chunk: tk.Chunk, coverage: float):
    """(document, item, windows, coverage, changed) of every contaminated pair of the chunk."""
    if index.plain is None:
        return
    t, known = Tokens(chunk), set()
    views = (_by_view(i, v, coverage, index.seen, kind) for i, v, kind in zip(index.views, t.views(), VIEWS, strict=True))
    for found in [*views, _by_place(index.plain, t, coverage, index.seen)]:
        for doc, item, *rest in found:
            if (doc, item) not in known:
                known.add((doc, item))
                yield doc, int(index.ids[item]), *rest


def _grouped(keys: tuple[np.ndarray, ...], *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Columns sorted by the keys, and the bounds of the rows with equal keys but the last."""
    o = np.lexsort(keys[::-1])
    cut = np.zeros(max(len(o) - 1, 0), bool)
    for k in keys[:-1]:
        cut |= k[o][1:] != k[o][:-1]
    return np.concatenate([[0], np.flatnonzero(cut) + 1, [len(o)]]), [c[o] for c in columns]


def _by_view(index: ViewIndex, t: View, coverage: float, seen: Seen, kind: int):
    rows = []
    for w, entry in index.by.items():
        pos, h = t.windows(w, _literals(w))
        ok = seen.holds(h, kind)
        pos, at = _joined(entry, pos[ok], h[ok])
        if len(pos):
            rows.append((pos, at, np.full(len(pos), w)))
    if not rows:
        return
    pos, at, width = (np.concatenate(x) for x in zip(*rows, strict=True))
    cut, (pos, at, width) = _grouped((t.doc[pos], index.view.doc[at], at), pos, at, width)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        item = int(index.view.doc[at[a]])
        covered = len(np.unique(at[a:b]))
        share = covered / index.total[item]
        if share < coverage:
            continue
        steps = np.arange(width[a])
        i, d = (at[a:b, None] + steps).ravel(), (pos[a:b, None] + steps).ravel()
        slot = index.view.kind[i] > 0
        diagonal = np.repeat(pos[a:b] - at[a:b], len(steps))
        # Each copy of the item in the document fills the slots in its own way.
        for g in np.unique(diagonal):
            mine = diagonal == g
            if len(np.unique(i[mine])) < coverage * len(np.unique(i)):
                continue
            x, y = index.view.literal[i[mine & slot]], t.literal[d[mine & slot]]
            if _consistent(x, y):
                yield int(t.doc[pos[a]]), item, covered, float(share), bool((x != y).any())
                break


def _by_place(index: PlainIndex, t: Tokens, coverage: float, seen: Seen):
    """Pairs that match token by token, in whatever case: a copy with other names and numbers whose
    slots are consistent, or an exact copy of its share or of RUN tokens. Where the former matches,
    its slots decide over exact runs of less than twice RUN tokens."""
    rows = [(pos, at, np.full(len(pos), w), np.full(len(pos), exact)) for pos, at, w, exact in index.hits(t, seen) if len(pos)]
    if not rows:
        return
    pos, at, width, exact = (np.concatenate(x) for x in zip(*rows, strict=True))
    cut, (pos, at, width, exact) = _grouped((t.doc[pos], index.view.doc[at], pos - at, at), pos, at, width, exact)
    item = index.view.doc[at[cut[:-1]]]
    n_exact = np.add.reduceat(exact.astype(np.int64), cut[:-1])
    n_masked = np.diff(cut) - n_exact
    exactly = n_exact / np.maximum(index.total_exact[item], 1)
    as_template = n_masked / np.maximum(index.total_masked[item], 1)
    longest = _longest(at, width, exact, cut)
    for k in np.flatnonzero((exactly >= coverage) | (as_template >= coverage) | (longest >= RUN)):
        a, b = cut[k], cut[k + 1]
        pair = int(t.doc[pos[a]]), int(item[k])
        if n_masked[k] and as_template[k] >= coverage:
            i = np.unique(at[a:b][~exact[a:b], None] + np.arange(width[a]))
            i = i[index.view.kind[i] > 0]
            x, y = index.value[i], t.value[i + pos[a] - at[a]]
            if _consistent(x, y):
                yield *pair, int(n_masked[k]), float(as_template[k]), bool((x != y).any())
                continue
            if longest[k] < 2 * RUN:
                continue
        yield *pair, int(n_exact[k]), float(exactly[k]), False


def _longest(at: np.ndarray, width: np.ndarray, exact: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Tokens of the longest exact run of each group of rows sorted by at."""
    out = np.zeros(len(cut) - 1, np.int64)
    e = np.flatnonzero(exact)
    if len(e):
        group = np.searchsorted(cut, e, side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (at[e][1:] != at[e][:-1] + 1)]))
        np.maximum.at(out, group[new], np.diff(np.concatenate([new, [len(e)]])) + width[e[new]] - 1)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, shortest: int = 5, coverage: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, reparameterised: documents that hold benchmark items.

    A pair counts when at least ``coverage`` of the item's windows occur in the document, either
    as templates with consistent slots or with every token as it is, in any letter case. Items of
    fewer than ``window`` tokens are one window. Items of fewer than ``shortest`` tokens, and windows
    that are over half placeholders, have no template: they count as they are, down to one token.
    A run of 13 tokens of an item as they are counts whatever its share of the item. If the rest of
    the item stands around it with slots that contradict each other, it takes 26.
    Of items without a template a count such as 1 2 3 4 of fewer than 13 numbers is left out. Null or empty texts match nothing; rows with a null id are compared like others, and repeated rows
    each. An empty table gives no row, and neither does an empty benchmark. Long texts are matched whole.
    Only id and text are read, so other columns of any name don't matter.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    space, found, schema = Workspace(docs.sparkSession, "decontam"), [], "doc_id bigint, item_id bigint, n_windows bigint, coverage double, reparameterised boolean"
    for n, (shared, last) in enumerate(_indexes(docs.sparkSession, benchmark, item_id, item_text, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared, window, shortest)
            for b in batches:
                out = list(_in_batch(index, b.column(1), coverage))
                ids = b.column(0).take(pa.array([m[0] for m in out], pa.int64()))
                cols = [[m[j] for m in out] for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], ["doc_id", "item_id", "n_windows", "coverage", "reparameterised"])

        pairs = src.mapInArrow(run, schema)
        if last and not n:
            return pairs
        # Of several blocks each is finished before the next, so that one is broadcast at a time.
        found.append(space.write(pairs, f"block-{n}"))
        shared.unpersist()
    return reduce(DataFrame.unionAll, found)


_built: dict[tuple, Index] = {}


def _index(shared, window: int, shortest: int) -> Index:
    """The windows of a broadcast block of items, built once in a worker."""
    items = shared.value
    key = (id(items), window, shortest)
    if key not in _built:
        _built.clear()
        _built[key] = Index(items, window, shortest)
        _built[key].items = items  # keeps the id from being used again
    return _built[key]


def _indexes(spark, benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """A broadcast of each block of about block_bytes of item text, and whether it is the last."""
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        yield spark.sparkContext.broadcast([(r[0], r[1]) for r in rows]), k == blocks - 1


def _in_batch(index: Index, texts: pa.Array, coverage: float):
    for chunk in tk.chunks(texts, 1 << 20):
        for m in _matches(index, chunk, coverage):
            yield chunk.first + m[0], *m[1:]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, shortest: int = 5, coverage: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, as ``contaminated`` finds them: in one pass for
    a benchmark of one block, else a pass for each block over stored documents and an anti-join of the rows found.
    All columns are kept; rows with a null or repeated id are judged each by its own text."""
    docs, own = aside(docs, text)
    place, schema = docs.columns.index(text), docs.schema
    spark, space, stored = docs.sparkSession, Workspace(docs.sparkSession, "decontam"), None
    for n, (shared, last) in enumerate(_indexes(spark, benchmark, item_id, item_text, block_bytes)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared, window, shortest)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in _in_batch(index, b.column(place), coverage)]] = False
                yield b.filter(pa.array(keep))

        def held(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared, window, shortest)
            for b in batches:
                at = np.unique([m[0] for m in _in_batch(index, b.column(1), coverage)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at))], ["place"])

        if last and stored is None:
            left = docs.mapInArrow(run, schema)
            return left.select(*[F.col(n).alias(c) for c, n in own.items()])
        # Several blocks: each one's hits are written, and its broadcast goes, before the next.
        if stored is None:
            stored = space.write(docs.withColumn("__place", F.monotonically_increasing_id()), "docs")
        space.write(stored.select("__place", text).mapInArrow(held, "place bigint"), f"hits/block={n}")
        shared.unpersist()
    hits = spark.read.schema("place bigint, block int").parquet(space.path("hits"))
    left = stored.join(hits.hint("merge"), F.col("__place") == F.col("place"), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in own.items()])


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
