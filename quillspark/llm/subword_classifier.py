"""A quality classifier over learned subword embeddings, averaged for each document.

Words of a text (lower case, split at white space) and the runs of 3 to 5 characters inside of words, where one space before
and after a word counts as its bound, are hashed to ``2**BITS`` buckets each with a learned vector of ``DIM`` numbers. A word
that repeats the one before it goes to one bucket, whatever it is. A document is the average of its words' vectors and of its character n-grams', half each; a softmax over two classes reads it. Vectors and softmax are
learned together by stochastic gradient descent, text by text, from a bounded sample of labelled documents; classes
weigh as much as they have labels, so scores are probabilities. A part of the sample kept aside picks the number of
rounds, and then a temperature and bias of the softmax on scores whose labels were not learned from.

At scoring the softmax and average are linear but for the last step, so each bucket's vector is first folded with the softmax's
weights into one number; :func:`embed` gives the averaged vectors themselves.

Edge cases: a null or empty text has the zero vector, and the softmax's bias as its score; without labels of both classes
every score is the share of label 1 (1 without labels); repeated rows get equal scores; a column ``score`` or ``vector`` of the
documents is replaced, other columns pass through whatever their names; an empty table gives no rows; a row without id is scored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from quillspark.llm import samples, store
from quillspark.llm import textvec as V

#: Buckets of words and of n-grams (powers of two), and length of vectors.
BITS, DIM, SIZES = 16, 16, (3, 4, 5)
#: Bounds of what is fitted: labelled documents of each class; most rounds over them, and rounds without gain that end it.
SAMPLE, ROUNDS, PATIENCE = 2000, 12, 3
RATE, DECAY = 60.0, 1e-7
#: Hash of a word that repeats the one before it.
AGAIN = V.U(0)
#: The share of a document that its words' average has; n-grams have the rest.
WORDS = 0.5


def parts(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all words, then of all n-grams of characters; n-grams have the upper half of the buckets."""
    low = V.lowered(data, latin=True)
    start, end, doc = V.runs(V.NOT_SPACE[low], off)
    half = 1 << (BITS - 1)
    words = V.span_hashes(low, start, end)
    # said again: one bucket for all words
    words[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])] = AGAIN
    words = (words >> V.U(65 - BITS)).astype(np.int64)
    low = np.where(V.SPACE[low], np.uint8(0x20), low)
    at = np.flatnonzero((low & 0xC0) != 0x80)
    owner, ends = np.searchsorted(off, at, "right") - 1, np.append(at, len(low))
    spaces = np.concatenate(([0], np.cumsum(low[at] == 0x20)))
    found, bucket = [], []
    for k in SIZES:
        n = len(at) - k + 1
        if n <= 0:
            continue
        # no space but at the ends
        good = (owner[:n] == owner[k - 1 :]) & (spaces[k - 1 : k - 1 + n] == spaces[1 : 1 + n])
        first = np.flatnonzero(good)
        h = V.span_hashes(low, at[first], ends[first + k])
        found.append(owner[first])
        bucket.append((h >> V.U(65 - BITS)).astype(np.int64) + half)
    z = np.zeros(0, np.int64)
    return [(doc, words), (np.concatenate(found) if found else z, np.concatenate(bucket) if bucket else z)]


def shares(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets, and what each counts in the average."""
    n = len(off) - 1
    keys, weights = [], []
    for (doc, bucket), part in zip(parts(data, off), (WORDS, 1 - WORDS), strict=True):
        key, count = np.unique(doc << BITS | bucket, return_counts=True)
        keys.append(key)
        weights.append(part * count / np.bincount(doc, minlength=n)[key >> BITS])
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    cut = np.searchsorted(key >> BITS, np.arange(n + 1))
    own = key & ((1 << BITS) - 1)
    return [(own[x:y], weight[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class Classifier:
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of class 1 against class 0, and the logit of an empty text."""
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(float), float(self.bias[1] - self.bias[0])


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


class _Fit:
    """Vectors and softmax, and rounds of descent."""

    def __init__(self):
        rng = np.random.default_rng(7)
        self.v = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        self.w = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2)

    def round(self, texts: list, rate: float) -> None:
        for own, weight, y, weigh in texts:
            rows = self.v[own]
            mean = weight @ rows
            z = mean @ self.w + self.b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = (p * weigh).astype(np.float32)
            # vectors learn at the full rate, as an average divides it among them
            rows -= rate * (weight[:, None] * (self.w @ g)[None, :] + DECAY * rows)
            self.v[own] = rows
            self.w -= 0.02 * rate / RATE * np.outer(mean, g)
            self.b -= 0.02 * rate / RATE * g

    def logits(self, texts: list) -> np.ndarray:
        d = self.w[:, 1] - self.w[:, 0]
        return np.array([float(weight @ (self.v[own] @ d)) for own, weight, _, _ in texts]) + float(self.b[1] - self.b[0])


def _loss(logit: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> float:
    return float((weigh * np.logaddexp(0, np.where(y == 1, -logit, logit))).sum() / weigh.sum())


def _tempered(logit: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits probabilities, by Newton's method with halved steps."""
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    weigh, x, at, pull = weigh / weigh.sum(), np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0]), np.array([1e-3, 1e-3])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weigh * (np.logaddexp(0, z) - soft * z)).sum() + 0.5 * (pull * (at - [1, 0]) ** 2).sum())

    now = loss(at)
    for _ in range(50):
        p = _chance(x @ at)
        g = x.T @ (weigh * (p - soft)) + pull * (at - [1, 0])
        move = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
        while (then := loss(at - move)) > now and np.abs(move).max() > 1e-9:
            move /= 2
        if now - then < 1e-12:
            break
        at, now = at - move, then
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float) -> Classifier:
    """Rows: buckets, weights, label, in an order that has nothing to do with labels. share: of label 1 among all labelled ones."""
    y = np.array([r[2] for r in rows])
    weigh = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    texts = [(own, weight.astype(np.float32), int(c), float(w)) for (own, weight, c), w in zip(rows, weigh, strict=True)]
    place = np.empty(len(y), np.int64)
    for c in (0, 1):
        place[y == c] = np.arange(int((y == c).sum()))
    # every class keeps texts on both sides where it has two
    aside = (place % 4 == 1) if len(y) >= 8 else np.zeros(len(y), bool)

    def rate(k: int) -> float:
        return RATE * (1 - k / ROUNDS)

    rounds, slope, shift = ROUNDS, 1.0, 0.0
    if aside.any() and len(set(y[aside])) == 2:
        f, kept, best = _Fit(), [t for t, a in zip(texts, aside, strict=True) if a], None
        learnt = [t for t, a in zip(texts, aside, strict=True) if not a]
        for k in range(ROUNDS):
            f.round(learnt, rate(k))
            logit = f.logits(kept)
            loss = _loss(logit, y[aside], weigh[aside])
            if best is None or loss < best[0]:
                best = loss, k + 1, logit
            elif k + 1 - best[1] >= PATIENCE:
                break
        rounds = best[1]
        slope, shift = _tempered(best[2], y[aside], weigh[aside])
    f = _Fit()
    for k in range(rounds):
        f.round(texts, rate(k))
    return Classifier(f.v, (f.w * slope).astype(np.float32), f.b * slope + np.array([0, shift]))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", where=None, per_class: int = SAMPLE) -> Classifier:
    """Fits on the rows of ``labels`` for which ``where`` holds, at most ``per_class`` documents of each class."""
    sample, count = samples.labelled(docs, labels, label, per_class, where)
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 1.0
    if not (count.get(0) and count.get(1)):
        return Classifier(np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 2), np.float32), np.array([0.0, 40.0 if share else -40.0]))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), V.CHUNK // 4):
                own, weight = zip(*shares(data, off), strict=True)
                found = [pa.array([x.astype(t).tobytes() for x in part], pa.binary()) for part, t in ((own, np.uint16), (weight, np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("label").slice(lo, hi - lo), *found], ["doc_id", "label", "buckets", "weights"])

    # one row for each sampled document reaches the driver, of at most 2**BITS buckets
    got = sample.mapInArrow(extract, "doc_id long, label int, buckets binary, weights binary").toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "label", "buckets", "weights")), strict=True), key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), *r))
    del got
    made = fit([(np.frombuffer(own, np.uint16), np.frombuffer(weight, np.float32), y) for _, y, own, weight in rows], share)
    del rows
    store.give_back()
    return made


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with ``score``, the probability of label 1."""
    docs = docs.drop("score")
    shipped, at = docs.sparkSession.sparkContext.broadcast(model.folded()), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        adds, empty = shipped.value
        for b in batches:
            got = [np.zeros(0)]
            for lo, hi, data, off in V.chunks(b.column(at), V.CHUNK // 4):
                z = np.full(hi - lo, empty)
                for (doc, bucket), part in zip(parts(data, off), (WORDS, 1 - WORDS), strict=True):
                    z += part * np.bincount(doc, adds[bucket], hi - lo) / np.maximum(1, np.bincount(doc, minlength=hi - lo))
                got.append(_chance(z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got))], [*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def embed(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with ``vector``, the average of its words' and n-grams' vectors."""
    docs = docs.drop("vector")
    shipped, at = docs.sparkSession.sparkContext.broadcast(model.vectors), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        v = shipped.value
        for b in batches:
            made = [weight.astype(np.float32) @ v[own] for lo, hi, data, off in V.chunks(b.column(at), V.CHUNK // 4) for own, weight in shares(data, off)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.tolist() for m in made], pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("vector", ArrayType(FloatType()))]))
