"""Toxicity by weak supervision: many voters, a generative model of them, a linear classifier.

1. Voters. Lexicons of fixed words, patterns, and lexicons induced from labelled rows (words and word
   beginnings that labels go with) each vote or don't vote on a document. A document's votes are the
   bits of one integer.
2. Label model. P(toxic) and P(votes | toxic or not) are fitted by EM over the vote patterns of all
   documents. Votes of a class form a tree: each voter depends on the class and on the voter that it is
   most correlated with in both classes (the tree of the largest conditional mutual information), so
   that lexicons that share words don't count twice. A given label is one more voter, with an
   accuracy of its own, missing on most rows.
3. Classifier. A logistic regression on words, word beginnings and votes learns the posterior labels of
   the labelled sample, and scores every document.

Only the fit uses a sample: at most ``per_label`` rows of each label, those with the smallest hashed
ids. The vote patterns are counted over all documents, and each document is scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .workspace import Workspace, aside

#: Words of the fixed lexicons, by kind; lower case.
LEXICONS = {
    "insult": "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool imbecile loser losers clown clowns jerk idiotin trottel dummkopf dumm blöd versager idiote idiotes stupide crétin crétins imbécile bouffon idiota idiotas estúpido estúpida imbécil tonto payaso perdedor",
    "contempt": "pathetic worthless disgusting useless repulsive vile filthy revolting despicable erbärmlich wertlos widerlich ekelhaft nutzlos pathétique minable répugnant dégoûtant nul patético asqueroso inútil repugnante despreciable",
    "dehumanising": "scum trash garbage vermin filth parasite parasites subhuman abschaum müll ungeziefer ordure déchet vermine racaille basura escoria",
}
#: Beginnings of hostile sentences, as word sequences.
HOSTILE = ("shut up", "get lost", "hate you", "you suck", "go to hell", "kill you", "halt die klappe", "ta gueule", "ferme la", "vete al infierno")
PREFIXES = (4, 5, 6, 7)
#: Votes: each lexicon at all and densely, then the patterns, then the induced lexicons at all and densely.
PATTERNS = ("addressed", "hostile", "masked", "stretched", "starred", "shouting", "exclaiming")
TIERS = ("word_strong_0", "word_strong_1", "word_medium", "stem_strong_0", "stem_strong_1", "stem_medium")
VOTERS = [f"{x}_{how}" for x in LEXICONS for how in ("any", "dense")] + list(PATTERNS) + [f"{x}_{how}" for x in TIERS for how in ("any", "dense")]

#: Weights of votes before anything is learnt; the fit departs from them only where labels give cause.
PRIOR = {f"{x}_any": 2.0 for x in LEXICONS} | {f"{x}_dense": 1.0 for x in LEXICONS} | {"addressed": 1.5, "hostile": 1.5, "masked": 1.5, "stretched": 1.5}

_TABLE = tk.byte_table(53)
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
#: Digits and signs that stand for letters.
_MASKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_UNMASK = tk.LOWER.copy()
_MASKED = _LETTER.copy()
for _sign, _letter in _MASKS.items():
    _UNMASK[ord(_sign)] = ord(_letter)
    _MASKED[ord(_sign)] = True


def _hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return tk.span_hash(tk.prefix(_TABLE[data]), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def _collapsed(word: bytes) -> bytes:
    return bytes(c for i, c in enumerate(word) if not i or c != word[i - 1])


_FIXED = [np.sort(_hash([w.encode() for w in words.split()])) for words in LEXICONS.values()]
_ALL_FIXED = np.unique(np.concatenate(_FIXED))
_STRETCHED = np.unique(_hash([_collapsed(w.encode()) for words in LEXICONS.values() for w in words.split()]))
_YOU = np.sort(_hash([b"you", b"your", b"youre", b"du", b"tu", b"usted"]))
_HOSTILE = [_hash([w.encode() for w in phrase.split()]) for phrase in HOSTILE]


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Words:
    """The words of a chunk as hashes, with the hashes of their beginnings, and what the patterns need."""

    def __init__(self, chunk: tk.Chunk):
        self.chunk, lower = chunk, tk.LOWER[chunk.data]
        self.pre = tk.prefix(_TABLE[lower])
        self.starts, self.ends, self.doc = tk.runs(_LETTER[chunk.data], chunk.bounds)
        self.word = tk.span_hash(self.pre, self.starts, self.ends)
        self.n_words = tk.counts_by_doc(self.doc, chunk.n)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every word and of its beginnings."""
        out, docs = [self.word], [self.doc]
        for k in PREFIXES:
            on = np.flatnonzero(self.ends - self.starts > k)
            out.append(tk.mix(tk.span_hash(self.pre, self.starts[on], self.starts[on] + k) + tk.U64(k)))
            docs.append(self.doc[on])
        return np.concatenate(out), np.concatenate(docs)

    def count(self, on: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[on], minlength=self.chunk.n)

    def patterns(self) -> list[np.ndarray]:
        """For each of PATTERNS whether it holds for a document."""
        c, w, doc, n = self.chunk, self.word, self.doc, self.chunk.n
        fixed = _in(w, _ALL_FIXED)
        you = np.flatnonzero(_in(w, _YOU))
        addressed = np.zeros(n, bool)
        for step in (1, 2, 3, 4):  # you, and an insult a few words on
            at = you[you + step < len(w)]
            at = at[fixed[at + step] & (doc[at + step] == doc[at])]
            addressed[doc[at]] = True
        hostile = np.zeros(n, bool)
        for phrase in _HOSTILE:
            at = np.flatnonzero(w[: len(w) - len(phrase) + 1] == phrase[0])
            for j, h in enumerate(phrase):
                at = at[(w[at + j] == h) & (doc[at + j] == doc[at])]
            hostile[doc[at]] = True
        starts, ends, own = tk.runs(_MASKED[c.data], c.bounds)
        signs = np.concatenate([[0], np.cumsum(_MASKED[c.data] & ~_LETTER[c.data])])
        some = (signs[ends] > signs[starts]) & (signs[ends] - signs[starts] < ends - starts)
        masked = np.zeros(n, bool)
        if some.any():
            masked[own[some][_in(tk.span_hash(tk.prefix(_TABLE[_UNMASK[c.data]]), starts[some], ends[some]), _ALL_FIXED)]] = True
        lower = tk.LOWER[c.data]
        stays = np.ones(len(lower), bool)
        stays[1:] = lower[1:] != lower[:-1]
        stays[self.starts] = True
        place = np.concatenate([[0], np.cumsum(stays)])
        shorter = np.flatnonzero(place[self.ends] - place[self.starts] < self.ends - self.starts - 1)
        stretched = np.zeros(n, bool)
        if len(shorter):
            pre = tk.prefix(_TABLE[lower[stays]])
            hit = _in(tk.span_hash(pre, place[self.starts[shorter]], place[self.ends[shorter]]), _STRETCHED) & ~fixed[shorter]
            stretched[doc[shorter[hit]]] = True
        star = c.data == 42
        around = np.flatnonzero(star[1:-1] & _LETTER[c.data[:-2]] & _LETTER[c.data[2:]]) if len(star) > 2 else np.zeros(0, np.int64)
        starred = np.bincount(np.searchsorted(c.bounds, around + 1, side="right") - 1, minlength=n)[:n] > 0
        upper = np.concatenate([[0], np.cumsum(_UPPER[c.data])])
        loud = self.count((self.ends - self.starts >= 3) & (upper[self.ends] - upper[self.starts] == self.ends - self.starts))
        shouting = (loud >= 3) & (10 * loud >= self.n_words)
        bang = c.data == 33
        three = np.flatnonzero(bang[2:] & bang[1:-1] & bang[:-2]) if len(bang) > 2 else np.zeros(0, np.int64)
        exclaiming = np.bincount(np.searchsorted(c.bounds, three, side="right") - 1, minlength=n)[:n] > 0
        return [addressed, hostile, masked, stretched, starred, shouting, exclaiming]


@dataclass
class Lexicon:
    """Features that go with a label: hashes, ascending, and the tier of each (-1: in none)."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    tier: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, feature and count of the features that occur."""
        h, doc = words.features()
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        on = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        pair, count = np.unique(doc[on] * max(len(self.hashes), 1) + at[on], return_counts=True)
        return pair // max(len(self.hashes), 1), pair % max(len(self.hashes), 1), count

    def votes(self, words: Words, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The bits of VOTERS for each document."""
        counts = [words.count(_in(words.word, known)) for known in _FIXED]
        doc, of, count = hits
        induced = [np.bincount(doc[on], count[on], minlength=words.chunk.n) for on in (self.tier[of] == t for t in range(len(TIERS)))]
        both = lambda c: [c >= 1, (c >= 2) & (200 * c >= words.n_words)]
        bits = [x for c in counts for x in both(c)] + words.patterns() + [x for c in induced for x in both(c)]
        return sum((b.astype(np.int64) << i for i, b in enumerate(bits)), np.zeros(words.chunk.n, np.int64))


# --- induced lexicons --------------------------------------------------------------------------


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> for each feature how many documents of each label have it, summed in the task."""
    for b in batches:
        toxic, keys = b.column(1).to_numpy(zero_copy_only=False).astype(bool), []
        for chunk in tk.chunks(b.column(0)):
            words = Words(chunk)
            h, doc = words.features()
            short = np.zeros(len(h), bool)
            short[: len(words.word)] = True
            order = np.lexsort((doc, h))
            h, doc, short = h[order], doc[order], short[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
            keys.append((h[first], toxic[chunk.first + doc[first]], short[first]))
        if keys:
            h, y, word = (np.concatenate(x) for x in zip(*keys, strict=True))
            u, at = np.unique(h, return_inverse=True)
            ones, whole = np.bincount(at, y, minlength=len(u)).astype(np.int64), np.zeros(len(u), bool)
            whole[at] = word
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(ones), pa.array(np.bincount(at, minlength=len(u)) - ones), pa.array(whole)], ["feature", "ones", "zeros", "word"])


def _informative(counts: DataFrame, n1: int, n0: int, most: int, least_gain: float) -> DataFrame:
    """Features that go with label 1: gain is twice the log of the likelihood ratio against no difference."""
    p, r1, r0 = (n1 + 0.5) / (n1 + n0 + 1), F.col("ones").cast("double"), F.col("zeros").cast("double")
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((r1 + r0) * share))).otherwise(0.0)
    lift = ((r1 + 0.5) / (n1 + 1)) / ((r0 + 0.5) / (n0 + 1))
    scored = counts.withColumn("gain", 2 * (part(r1, p) + part(r0, 1 - p))).withColumn("lift", lift)
    return scored.where((F.col("gain") >= least_gain) & (F.col("lift") >= 3)).orderBy(F.desc("gain"), "feature").limit(most)


def _lexicon(rows: list) -> Lexicon:
    h = np.array([r["feature"] for r in rows], np.int64).view(np.uint64)
    word, lift, gain = (np.array([r[c] for r in rows]) for c in ("word", "lift", "gain"))
    tier = np.full(len(rows), -1)
    for i in range(len(rows)):
        base = 0 if word[i] else 3
        if lift[i] >= 20 and gain[i] >= 16:
            tier[i] = base + int(h[i] & tk.U64(1))
        elif gain[i] >= 16:
            tier[i] = base + 2
    order = np.argsort(h)
    return Lexicon(h[order], tier[order])


# --- label model -------------------------------------------------------------------------------


def _unpacked(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


def moments(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted numbers of documents on which two voters vote, for each class (columns of ``weight``); the last
    voter votes always."""
    x = np.concatenate([_unpacked(votes), np.ones((len(votes), 1))], axis=1)
    return np.stack([(x * w[:, None]).T @ x for w in weight.T])


class LabelModel:
    """P(class) and, along a tree of voters, P(vote | class, vote of the parent), from moments of each class."""

    def __init__(self, m: np.ndarray, smooth: float = 0.5):
        total = m[:, -1, -1]
        self.prior = (total + smooth) / (total + smooth).sum()
        n11, n1 = m[:, :-1, :-1], np.diagonal(m, axis1=1, axis2=2)[:, :-1]
        # joint[y, a, b, i, j]: both votes of a pair, smoothed towards independence
        single = (n1 + smooth) / (total[:, None] + 2 * smooth)
        joint = np.empty((2, 2, 2, *n11.shape[1:]))
        joint[:, 1, 1], joint[:, 1, 0], joint[:, 0, 1] = n11, n1[:, :, None] - n11, n1[:, None, :] - n11
        joint[:, 0, 0] = total[:, None, None] - n1[:, :, None] - n1[:, None, :] + n11
        of = np.stack([1 - single, single], axis=1)
        joint = np.maximum(joint, 0) + smooth * of[:, :, None, :, None] * of[:, None, :, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        left, right = joint.sum(axis=2, keepdims=True), joint.sum(axis=1, keepdims=True)
        information = np.einsum("yabij,y->ij", joint * np.log(joint / (left * right)), self.prior)
        self.accuracy, self.information = single, information
        self.parent = self._tree(information)
        given = (joint / left)[:, :, 1]  # [y, a, i, j]: that j votes when i does (a)
        i = np.arange(len(self.parent))
        rooted = self.parent < 0
        self.given = np.where(rooted[None, None, :], single[:, None, :], given[:, :, self.parent, i])

    @staticmethod
    def _tree(information: np.ndarray) -> np.ndarray:
        """Parents of a spanning tree of the largest sum, grown from voter 0."""
        n = len(information)
        parent, near = np.full(n, -1), np.zeros(n, np.int64)
        best = information[0].copy()
        best[0] = -np.inf
        for _ in range(n - 1):
            j = int(np.argmax(best))
            parent[j], best[j] = near[j], -np.inf
            better = (information[j] > best) & (best > -np.inf)
            near[better], best[better] = j, information[j][better]
        return parent

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        x = _unpacked(votes).astype(int)
        up = np.where(self.parent < 0, 0, x[:, self.parent])
        p = self.given[:, up, np.arange(x.shape[1])]
        ll = np.where(x == 1, np.log(p), np.log1p(-p)).sum(axis=2)
        return np.log(self.prior[1] / self.prior[0]) + ll[1] - ll[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expected(shared):
    """Vote patterns with their counts -> moments under the label model, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, m = shared.value, np.zeros((2, len(VOTERS) + 1, len(VOTERS) + 1))
        for b in batches:
            votes, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(votes), 1 << 14):
                q = _sigmoid(model.log_odds(votes[at : at + (1 << 14)]))
                m += moments(votes[at : at + (1 << 14)], n[at : at + (1 << 14), None] * np.stack([1 - q, q], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], ["m"])

    return run


def fit_label_model(patterns: DataFrame, votes: np.ndarray, labels: np.ndarray, rounds: int = 8) -> tuple[LabelModel, np.ndarray]:
    """The label model of all documents (``patterns``: votes, n) and of labelled rows, and how often a label is
    right in each class. It starts from the labelled rows' own labels."""
    spark = patterns.sparkSession
    hard = np.stack([1.0 - labels, labels.astype(float)], axis=1)
    model, right = LabelModel(moments(votes, hard)), np.array([0.98, 0.9])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        # A few kilobytes for each task that reads the patterns.
        m = sum((np.frombuffer(r[0]).reshape(2, len(VOTERS) + 1, -1) for r in patterns.mapInArrow(_expected(shared), "m binary").collect()), np.zeros((2, len(VOTERS) + 1, len(VOTERS) + 1)))
        shared.unpersist()
        q = posterior(model, right, votes, labels)
        both = np.stack([1 - q, q], axis=1)
        agree = (both * hard).sum(axis=0)
        right = np.clip((agree + 9) / (both.sum(axis=0) + 10), 0.5, 0.999)
        model = LabelModel(m + moments(votes, both))
    return model, right


def posterior(model: LabelModel, right: np.ndarray, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(toxic) of labelled rows; the label is a voter that is right with its accuracy in each class."""
    told = np.where(labels == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
    return _sigmoid(model.log_odds(votes) + told)


# --- classifier --------------------------------------------------------------------------------


def _columns(lexicon: Lexicon, words: Words, hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, column and value: for each feature whether it occurs and how densely."""
    doc, of, count = hits
    dense = np.sqrt(np.minimum(1.0, 100 * count / np.maximum(words.n_words[doc], 1)))
    return np.concatenate([doc, doc]), np.concatenate([of, of + len(lexicon.hashes)]), np.concatenate([np.ones(len(doc)), dense])


def train(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, dims: int, target: np.ndarray, weight: np.ndarray, prior: np.ndarray, penalty: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the bias last, by accelerated gradient steps. The
    penalty is on the distance from ``prior``, but for the bias."""
    w = v = np.append(prior, 0.0)
    size = np.bincount(row, value**2, minlength=n) + 1
    step = 1 / (0.25 * float((weight * size).max() * max(1.0, np.sqrt(n))) + penalty)
    slope = lambda x: np.concatenate([np.bincount(column, value * x[row], minlength=dims), [x.sum()]])
    loss = lambda z: float((weight * (np.logaddexp(0, z) - target * z)).sum())
    made = lambda x: np.bincount(row, value * x[column], minlength=n) + x[-1]
    far = lambda x: float((x[:-1] - prior) @ (x[:-1] - prior))
    z = made(v)
    for i in range(rounds):
        g = slope(weight * (_sigmoid(z) - target))
        g[:-1] += penalty * (v[:-1] - prior)
        here = loss(z) + 0.5 * penalty * far(v)
        while True:  # the longest step that falls as far as its slope says
            new = v - step * g
            if loss(made(new)) + 0.5 * penalty * far(new) <= here - 0.5 * step * float(g @ g) + 1e-12 or step < 1e-12:
                break
            step /= 2
        v, w = new + i / (i + 3) * (new - w), new
        z, step = made(v), step * 1.3
    return w


def _prior(features: int) -> np.ndarray:
    return np.concatenate([np.zeros(features), [PRIOR.get(v, 0.0) for v in VOTERS]])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # occurrence and density of each feature, votes, bias
    label_model: LabelModel | None = None
    right: np.ndarray | None = None

    def score(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Probability and votes of each document of a chunk."""
        hits = self.lexicon.hits(words)
        doc, at, value = _columns(self.lexicon, words, hits)
        votes = self.lexicon.votes(words, hits)
        z = np.bincount(doc, value * self.weights[at], minlength=words.chunk.n) + self.weights[-1]
        return _sigmoid(z + _unpacked(votes) @ self.weights[-1 - len(VOTERS) : -1]), votes


def _vote(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            seen: list[np.ndarray] = [np.zeros(0, np.int64)]
            for chunk in tk.chunks(b.column(0)):
                words = Words(chunk)
                seen.append(lexicon.votes(words, lexicon.hits(words)))
            votes, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(n.astype(np.int64))], ["votes", "n"])

    return run


def _sampled(shared):
    """(text, label) of the sample -> label, votes, packed columns of the classifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for b in batches:
            for chunk in tk.chunks(b.column(0)):
                words = Words(chunk)
                hits = lexicon.hits(words)
                doc, at, value = _columns(lexicon, words, hits)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(chunk.n + 1))
                packed = [at[order[x:y]].astype(np.int32).tobytes() + value[order[x:y]].astype(np.float32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(chunk.first, chunk.n), pa.array(lexicon.votes(words, hits)), pa.array(packed, pa.binary())], ["label", "votes", "columns"])

    return run


def _sample(labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_label`` ids of each label, those with the smallest hashes, and how many ids each label has."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    sizes = dict(rows.groupBy("label").count().collect())
    parts = [rows.where((F.col("label") == y) & (F.col("h") / float(1 << 64) + 0.5 < min(1.0, 2.0 * per_label / n))).orderBy("h", "doc_id").limit(per_label) for y, n in sorted(sizes.items())]
    chosen = parts[0] if parts else rows.limit(0)
    for p in parts[1:]:
        chosen = chosen.unionAll(p)
    return chosen.select(F.col("doc_id").alias("__id"), "label"), sizes


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 6000, most_features: int = 4096, least_gain: float = 12.0) -> Model:
    """The model of ``docs`` from ``labels`` (doc_id, ``label`` 0 or 1). Other labels, and labels of no document,
    don't count; of an id labelled twice the higher label does, and of several rows of an id one text. Without labels of both kinds nothing is
    learnt, and only the fixed lexicons score."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession, "toxicity")
    chosen, sizes = _sample(labels.select("doc_id", F.col(label).alias("label")), per_label)
    # At most per_label ids of each label.
    known = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    # Of rows that repeat an id one counts, that of the smallest text hash; they become one in the task.
    once = known.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    sample = space.write(once.select("r.text", "r.label"), "sample")
    seen = dict(sample.groupBy("label").count().collect())
    if min(seen.get(0, 0), seen.get(1, 0)) == 0:
        return Model(Lexicon(), np.append(_prior(0), -3.0))
    counts = sample.mapInArrow(_feature_counts, "feature bigint, ones bigint, zeros bigint, word boolean").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.max("word").alias("word"))
    lexicon = _lexicon(_informative(counts, seen[1], seen[0], most_features, least_gain).collect())
    shared = spark.sparkContext.broadcast(lexicon)
    patterns = space.write(docs.select(F.col(text).alias("text")).mapInArrow(_vote(shared), "votes bigint, n bigint").groupBy("votes").agg(F.sum("n").alias("n")), "patterns")
    # The bounded sample.
    rows = sample.mapInArrow(_sampled(shared), "label int, votes bigint, columns binary").collect()
    y, votes = np.array([r["label"] for r in rows], np.int64), np.array([r["votes"] for r in rows], np.int64)
    model, right = fit_label_model(patterns, votes, y)
    cells = [np.frombuffer(r["columns"], np.int32, len(r["columns"]) // 8) for r in rows]
    values = [np.frombuffer(r["columns"], np.float32, offset=len(r["columns"]) // 2) for r in rows]
    dims = 2 * len(lexicon.hashes)
    vote_row, vote = np.nonzero(_unpacked(votes))
    row = np.concatenate([np.repeat(np.arange(len(rows)), [len(c) for c in cells]), vote_row])
    column = np.concatenate([*cells, dims + vote])
    value = np.concatenate([*values, np.ones(len(vote))]).astype(float)
    # As many of each label as the labelled rows have.
    share = np.array([sizes[k] / seen[k] for k in (0, 1)])
    weight = share[y] * len(y) / share[y].sum()
    weights = train(row, column, value, len(rows), dims + len(VOTERS), posterior(model, right, votes, y), weight, _prior(dims))
    return Model(lexicon, weights, model, right)


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with score, predicted (1 from the threshold) and votes (bits of VOTERS). A column
    of ``docs`` that has one of these names is replaced. A null or empty text is scored as one without words.
    An empty table gives no row, and repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src, own = aside(docs.drop("score", "predicted", "votes"), text)
    names, place = src.columns, src.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema), "score double", "predicted int", "votes bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(np.zeros(0), np.zeros(0, np.int64))]
            for chunk in tk.chunks(b.column(place)):
                found.append(shared.value.score(Words(chunk)))
            score, votes = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(votes)], [*names, "score", "predicted", "votes"])

    return src.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in own.items()], "score", "predicted", "votes")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    p = predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
