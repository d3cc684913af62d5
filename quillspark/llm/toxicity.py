"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (letters and digits, lower case) and the first five and the first four bytes of longer
words, hashed to ``2**BITS`` buckets; a term counts once for each text. Every bucket that occurs in at least ``LEAST``
texts of a bounded sample of labelled documents is an input: no input is chosen by its own connection with the label,
since a term that tells nothing alone may tell much beside another. The machine's logit is

    bias + sum of weight[i] + 1/2 (|sum of factor[i]|^2 - sum of |factor[i]|^2) / n

over the n inputs of a text, so every pair of inputs adds the inner product of their vectors. The driver fits weights
and vectors together from the first step on, by Adagrad: weights with a bound on each one's noise (L1, growing with the root of how many texts
have the input), vectors from small random ones with a decay. A fifth of the sample kept aside says how many rounds that
takes; then all of the sample is fitted with these rounds.

Edge cases: a null or empty text has no terms and gets the model's bias; without labels of both classes every score is
the share of toxic labels (0 without labels); repeated rows get equal scores; a column ``score`` of the documents is
replaced, other columns pass through whatever their names; an empty table gives no rows; a row without id is scored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import samples, store
from quillspark.llm import textvec as V

BITS = 20
#: Bounds of what is fitted: labelled documents of each class, texts that an input occurs in, length of vectors.
SAMPLE, LEAST, FACTORS = 4096, 3, 4
#: Of the fit: texts in a step, most rounds, rounds without gain that end it, and what vectors begin with.
STEP, ROUNDS, PATIENCE, START = 256, 24, 6, 0.01


@dataclass
class Machine:
    """Bucket b is input ``index[b]`` (negative: none)."""

    index: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, doc: np.ndarray, inputs: np.ndarray, n_docs: int) -> np.ndarray:
        """Probabilities from (text, input) pairs, ordered by text."""
        y = np.full(n_docs, self.bias) + np.bincount(doc, self.weight[inputs], n_docs)
        if self.factor.any():
            pairs = np.zeros(n_docs)
            for f in range(self.factor.shape[1]):
                v = self.factor[inputs, f].astype(float)
                pairs += np.bincount(doc, v, n_docs) ** 2 - np.bincount(doc, v * v, n_docs)
            y += 0.5 * pairs / np.maximum(1, np.bincount(doc, minlength=n_docs))
        return 1 / (1 + np.exp(-np.clip(y, -60, 60)))

    def linear_part(self) -> Machine:
        return Machine(self.index, self.bias, self.weight, np.zeros_like(self.factor))


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term occurrence."""
    low = V.lowered(data, latin=True)
    start, end, doc = V.runs(V.ALNUM[low], off)
    found_d, found_b = [doc], [V.span_hashes(low, start, end)]
    for k, n in enumerate((5, 4)):
        long = end - start > n
        found_d.append(doc[long])
        found_b.append(V.span_hashes(low, start[long], start[long] + n) ^ V.U(0x5851F42D4C957F2D * (k + 1)))
    return np.concatenate(found_d), (np.concatenate(found_b) >> V.U(64 - BITS)).astype(np.int64)


def distinct_inputs(data: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc, bucket = terms(data, off)
    k = index[bucket]
    some = k >= 0
    n = max(1, int(index.max(initial=0)) + 1)
    pair = np.unique(doc[some] * n + k[some])
    return pair // n, pair % n


class _Texts:
    """Texts of the sample in steps of STEP, each with its inputs by text and by input."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, weigh: np.ndarray, order: np.ndarray):
        self.steps = []
        for x in range(0, len(order), STEP):
            ids = order[x : x + STEP]
            size = np.array([len(rows[i]) for i in ids])
            inputs = np.concatenate([rows[i] for i in ids])
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), size)
            cols, inverse = np.unique(inputs, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            some = np.flatnonzero(size)
            first = np.searchsorted(inverse[by], np.arange(len(cols)))
            self.steps.append((y[ids], weigh[ids], size, doc, cols, inverse.astype(np.int32), by.astype(np.int32), first, some, (np.cumsum(size) - size)[some]))


class _Fit:
    def __init__(self, n_inputs: int, share: float, noise: np.ndarray, rng: np.random.Generator):
        self.rng, self.noise = rng, noise
        self.w, self.b = np.zeros(n_inputs, np.float32), float(np.log(share / (1 - share)))
        self.v = rng.normal(0, START, (n_inputs, FACTORS)).astype(np.float32)
        self.hw, self.hv, self.hb = np.full(n_inputs, 1e-8, np.float32), np.full((n_inputs, FACTORS), 1e-8, np.float32), 1e-8

    def logit(self, step: tuple) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        _, _, size, _, cols, inverse, _, _, some, at = step
        z = np.full(len(size), self.b, np.float32)
        if not len(some):
            return z, None, None
        z[some] += np.add.reduceat(self.w[cols][inverse], at)
        g = self.v[cols][inverse]
        s = np.zeros((len(size), FACTORS), np.float32)
        s[some] = np.add.reduceat(g, at, axis=0)
        z[some] += 0.5 / size[some] * ((s[some] ** 2).sum(1) - np.add.reduceat((g * g).sum(1), at))
        return z, g, s

    def round(self, texts: _Texts, rate: float = 0.5, rate_v: float = 0.05, decay: float = 0.5) -> None:
        for k in self.rng.permutation(len(texts.steps)):
            step = texts.steps[k]
            y, weigh, size, doc, cols, _, by, first, some, _ = step
            z, g, s = self.logit(step)
            err = (weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
            total = float(err.sum())
            self.hb += total * total
            self.b -= rate * total / self.hb**0.5
            if not len(some):
                continue
            gw = np.add.reduceat(err[doc][by], first)
            self.hw[cols] += gw * gw
            eta = rate / np.sqrt(self.hw[cols])
            u = self.w[cols] - eta * gw
            self.w[cols] = np.sign(u) * np.maximum(np.abs(u) - eta * self.noise[cols], 0)
            if g is not None:
                e = err / np.maximum(1, size)
                gv = np.add.reduceat((e[:, None] * s)[doc][by] - e[doc][by][:, None] * g[by], first, axis=0) + decay / len(y) * self.v[cols]
                self.hv[cols] += gv * gv
                self.v[cols] -= rate_v * gv / np.sqrt(self.hv[cols])

    def loss(self, texts: _Texts) -> float:
        total = 0.0
        for step in texts.steps:
            z = np.clip(self.logit(step)[0].astype(float), -30, 30)
            total += float((step[1] * (np.log1p(np.exp(z)) - step[0] * z)).sum())
        return total


def fit(rows: list[tuple[int, np.ndarray]], index: np.ndarray, share: float) -> Machine:
    """Fits on all sampled texts. Classes are weighed so that ``share`` of the weight is toxic."""
    n_inputs = int(index.max(initial=-1)) + 1
    y, inputs = np.array([r[0] for r in rows], float), [r[1] for r in rows]
    weigh = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    found = np.zeros(n_inputs)
    for k in inputs:
        found[k] += 1

    def new() -> _Fit:
        return _Fit(n_inputs, share, np.sqrt(found * share * (1 - share)).astype(np.float32) / len(rows), np.random.default_rng(7))

    every = np.random.default_rng(7).permutation(len(rows))
    fold = every % 5 == 4
    rounds = ROUNDS
    if fold.any() and not fold.all():
        aside, texts = _Texts(inputs, y, weigh, every[fold]), _Texts(inputs, y, weigh, every[~fold])
        f, least = new(), np.inf
        for k in range(1, ROUNDS + 1):
            f.round(texts)
            if (now := f.loss(aside)) < least:
                rounds, least = k, now
            elif k - rounds >= PATIENCE:
                break
        del aside, texts
    f, texts = new(), _Texts(inputs, y, weigh, every)
    for _ in range(rounds):
        f.round(texts)
    return Machine(index, f.b, f.w, f.v)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", where=None, per_class: int = SAMPLE) -> Machine:
    """Fits on the rows of ``labels`` for which ``where`` holds, at most ``per_class`` documents of each class."""
    sample, count = samples.labelled(docs, labels, label, per_class, where)
    index = np.full(1 << BITS, -1, np.int32)
    total = [min(count.get(y, 0), per_class) for y in (0, 1)]
    labelled_n = sum(count.values())
    share = count.get(1, 0) / labelled_n if labelled_n else 0.0
    if not all(total):
        return Machine(index, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text")):
                doc, bucket = terms(data, off)
                pair = np.unique(doc << BITS | bucket)
                own = (pair & ((1 << BITS) - 1)).astype(np.uint32)
                at = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
                found = pa.array([own[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("label").slice(lo, hi - lo), found], ["doc_id", "label", "buckets"])

    # one row for each sampled document reaches the driver
    got = sample.mapInArrow(extract, "doc_id long, label int, buckets binary").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["label"].to_pylist(), got["buckets"].to_pylist(), strict=True), key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), *r))
    del got
    seen = np.zeros(1 << BITS, np.int64)
    for _, _, body in rows:
        seen[np.frombuffer(body, np.uint32)] += 1
    index[seen >= LEAST] = np.arange(int((seen >= LEAST).sum()), dtype=np.int32)
    for i, (_, y, body) in enumerate(rows):
        own = index[np.frombuffer(body, np.uint32)]
        rows[i] = (y, own[own >= 0])
    made = fit(rows, index, share)
    del rows
    store.give_back()
    return made


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """docs with ``score``, the probability that the text is toxic."""
    docs = docs.drop("score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            got = [np.zeros(0)]
            for lo, hi, data, off in V.chunks(b.column(at)):
                got.append(m.score(*distinct_inputs(data, off, m.index), hi - lo))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got))], [*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    at = docs.columns.index("text")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
