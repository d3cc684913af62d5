"""Quality rules: counts with fixed limits, and a calibrated logistic regression on hashed n-grams.

Inputs of the regression are square roots of the shares of hashed 2- and 3-grams of characters (code points) and of
hashed words and word pairs in a text. It is fitted on a bounded sample of labelled documents and scored in Arrow
batches. Platt's calibration uses scores that no row's own label took part in: each of two halves of the sample is
scored by weights fitted on the other, at every size of the sample. Documents whose calibrated probability of quality 1
is below ``KEEP`` are dropped.

Edge cases: a null or empty text has zero counts and fails the base rule; without labels of both classes the
probability is the share of good labels (1 without labels); a probability of just ``KEEP`` keeps; repeated rows get
equal results; other columns are ignored by ``judge`` and pass through ``keep`` whatever their names; an empty table
gives no rows.
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

#: Bounds of what is fitted: labelled documents of each class, and hashed inputs of either kind.
SAMPLE, HALF = 2000, 2048
#: Fixed thresholds.
KEEP, MIN_WORDS, REPEAT_PERCENT, WINDOW = 0.15, 10, 20, 5
SYMBOL = np.zeros(256, np.int8)
SYMBOL[list(b"#*$%&|<>")] = 1


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the lines, split at \\n, that have a byte other than white space."""
    newline = np.flatnonzero(data == 10)
    start = np.concatenate((off[:-1], newline + 1))
    end = np.concatenate((off[1:], newline))
    start, end = np.sort(start, kind="stable"), np.sort(end, kind="stable")
    solid = np.concatenate(([0], np.cumsum(V.NOT_SPACE[data], dtype=np.int64)))
    start, end = start[: len(end)], end
    some = solid[np.minimum(end, len(data))] > solid[np.minimum(start, len(data))]
    start, end = start[some], end[some]
    return start, end, np.searchsorted(off, start, "right") - 1


def counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(off) - 1
    solid = V.NOT_SPACE[data]
    start, end, doc = V.runs(solid, off)
    words = np.bincount(doc, minlength=n)
    h = V.span_hashes(data, start, end)
    a, b, d = line_spans(data, off)
    lines, of = V.span_hashes(data, a, b), np.searchsorted(d, np.arange(n + 1))
    dup = np.array([(y - x) - len(np.unique(lines[x:y])) if y - x > 1 else 0 for x, y in zip(of[:-1], of[1:], strict=True)], np.int64)
    at, s = V.windows(h, doc, WINDOW)
    of = np.searchsorted(doc[at], np.arange(n + 1))
    cover = np.zeros(len(h) + 1, np.int64)
    for x, y in zip(of[:-1], of[1:], strict=True):
        if y - x > 1:
            order = np.argsort(s[x:y])
            same = s[x:y][order]
            eq = same[1:] == same[:-1]
            if eq.any():
                again = np.zeros(y - x, bool)
                again[order[1:][eq]] = again[order[:-1][eq]] = True
                w = at[x:y][again]
                cover[w] += 1
                np.add.at(cover, w + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": words.astype(np.int64),
        "word_chars": V.per_doc(solid & ((data & 0xC0) != 0x80), off),
        "n_symbols": V.per_doc(SYMBOL[data], off),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc, covered, n).astype(np.int64),
    }


def inputs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of 2 * HALF inputs for each text."""
    n = len(off) - 1
    out = np.zeros((n, 2 * HALF), np.float32)
    # characters begin at bytes other than continuation bytes
    at = np.flatnonzero((data & 0xC0) != 0x80)
    owner, ends = np.searchsorted(off, at, "right") - 1, np.append(at, len(data))
    for k in (2, 3):
        if len(at) >= k:
            inside = owner[: len(at) - k + 1] == owner[k - 1 :]
            start, doc = at[: len(at) - k + 1][inside], owner[: len(at) - k + 1][inside]
            h = V.span_hashes(data, start, ends[k:][inside])
            bucket = (h >> V.U(64 - 10)).astype(np.int64) + (k - 2) * (HALF // 2)
            out[:, :HALF] += np.bincount(doc * HALF + bucket, minlength=n * HALF).reshape(n, HALF)
    start, end, doc = V.runs(V.NOT_SPACE[data], off)
    h = V.span_hashes(data, start, end)
    at, pairs = V.windows(h, doc, 2)
    for d, g in ((doc, h), (doc[at], pairs)):
        out[:, HALF:] += np.bincount(d * HALF + (g >> V.U(64 - 11)).astype(np.int64), minlength=n * HALF).reshape(n, HALF)
    for half in (out[:, :HALF], out[:, HALF:]):
        half /= np.maximum(half.sum(1, keepdims=True), 1)
        np.sqrt(half, out=half)
    return out


@dataclass
class Regression:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weight + self.bias).astype(float) + self.shift, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows."""
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (weigh * (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y)).astype(x.dtype)
        gw, gb = x.T @ g + decay * w, float(g.sum())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw * gw, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = (w - rate * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)).astype(x.dtype)
        b -= rate * (mb / c1) / (vb / c2 + 1e-16) ** 0.5
    return w, b


def fit(x: np.ndarray, y: np.ndarray, share: float) -> Regression:
    """share: of good documents among all labelled ones. Rows come in an order that has nothing to do with labels."""
    weigh = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())).astype(np.float32)

    def weights(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, float]:
        return _logistic(x, y, weigh / max(weigh.sum(), 1e-30), 150, 0.05, 1e-5)

    # halves with the same share of each class, as far as whole rows allow
    place = np.empty(len(y), np.int64)
    for c in (0, 1):
        place[y == c] = np.arange(int((y == c).sum()))
    z = np.empty(len(y))
    for half in (place % 2 == 0, place % 2 == 1):
        other = ~half if (~half).any() else half
        w, b = weights(x[other], y[other], weigh[other])
        z[half] = (x @ w)[half] + b
    # Platt's targets keep the calibrated odds finite where the classes part cleanly
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, shift = _logistic(z[:, None], soft, weigh / weigh.sum(), 400, 0.05, 1e-4)
    w, b = weights(x, y, weigh)
    return Regression(w, b, float(max(slope[0], 1e-3)), shift)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", where=None, per_class: int = SAMPLE) -> Regression:
    """Fits on at most ``per_class`` labelled documents of each class."""
    sample, count = samples.labelled(docs, labels, label, per_class, where)
    total = sum(count.values())
    share = count.get(1, 0) / total if total else 1.0
    if not (count.get(0) and count.get(1)):
        return Regression(np.zeros(2 * HALF, np.float32), 0.0, 1.0, 40.0 if share else -40.0)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), V.CHUNK // 4):
                x = [r.tobytes() for r in inputs(data, off).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("label").slice(lo, hi - lo), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    got = sample.mapInArrow(extract, "doc_id long, label int, x binary").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["x"].to_pylist(), got["label"].to_pylist(), strict=True), key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[1]))
    del got
    x, y = np.empty((len(rows), 2 * HALF), np.float32), np.array([r[2] for r in rows], np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r[1], np.float16)
    del rows
    made = fit(x, y, share)
    del x
    store.give_back()
    return made


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def judge(docs: DataFrame, model: Regression, keep_at: float = KEEP) -> DataFrame:
    """doc_id, the five counts, base_failed, p_quality and kept of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), V.CHUNK // 2):
                c = counts(data, off)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
                p = m.probability(inputs(data, off))
                out = [b.column("doc_id").slice(lo, hi - lo), *map(pa.array, (*c.values(), failed, p, ~failed & (p >= keep_at)))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *c, "base_failed", "p_quality", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {BASE}, base_failed boolean, p_quality double, kept boolean")


def keep(docs: DataFrame, model: Regression, keep_at: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose text passes the base rule and the model, with their columns."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column(at), V.CHUNK // 2):
                c = counts(data, off)
                good = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= REPEAT_PERCENT * c["n_words"])
                good &= shipped.value.probability(inputs(data, off)) >= keep_at
                yield b.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
