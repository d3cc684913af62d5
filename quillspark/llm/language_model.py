"""Language-model scoring: context-tree weighting over bytes, and a smoothed unigram base score.

The model. Texts are read as lower-case bytes, preceded by ``depth`` bytes 0xFF and ended by one. A byte is eight
binary decisions; each decision under each context of the last 0 to ``depth`` bytes is a node with its own counts. A
node's Krichevsky-Trofimov estimate and the product over its longer contexts are mixed half and half at every depth
(Willems, Shtarkov and Tjalkens 1995); after training, the weights of the mixture along a path of contexts give the
probability of each decision, and their product the probability of the text.

The data flow. Every task reads its documents into units of about ``UNIT`` bytes and writes for each unit its texts
(compressed) and its distinct words and byte (depth + 1)-grams with their counts in training texts, zero included,
packed by shard: words by their hash, grams by the two bytes before the last. There is a shard for each ``SHARD``
bytes of text, ``MAX_SHARDS`` at most, and salts of ``SALT`` units, so a group of one shard and salt stays small at any size. Shards sum their
counts, first by salt and then by ever fewer salts, and price their grams; the nodes above them are one table of 65,536 rows at most. Words with
their counts and grams with their log-probabilities return to the units that hold them, and each unit scores its texts
with the slice of the model that it needs. So no task and no broadcast holds the model as a whole, and all counts come
from all training documents.

Edge cases: a null or empty text is one end token and one end byte; texts without training data get the uniform
estimate; a row without id is learned from and scored as one of training (the smallest long stands for a missing id
inside); repeated rows count each time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import store
from quillspark.llm import textvec as V

UNIT, DEPTH, SHARD, SALT = 8 << 20, 5, 32 << 20, 256
#: Most shards: a unit has a row for each, so rows grow as units do and no faster.
MAX_SHARDS = 4096
#: Least number of keys that are unpacked before they are summed.
FOLD = 1 << 20
NO_ID = -(1 << 63)
END_WORD = np.int64(0x1E4D)  # stands for the end token among word hashes
WORD, GRAM, TEXT = 0, 1, 2
PAD = 0xFF  # in no UTF-8 text


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series at x + 8."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(low)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate of a sequence with a zeros and b ones."""
    return np.where(a + b > 0, lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi), 0.0)


def grams(data: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(depth + 1)-byte grams as numbers, one for each byte and end, in order; and where each text's begin."""
    n = len(off) - 1
    at = off + np.arange(n + 1)
    size = np.diff(off)
    stream = np.full(len(data) + n * (depth + 1), PAD, np.uint8)
    stream[np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, size)] = data
    kind = np.uint32 if depth <= 3 else np.uint64
    last = np.arange(len(data) + n) + np.repeat((np.arange(n) + 1) * depth, size + 1)
    g = np.zeros(len(last), kind)
    for j in range(depth, -1, -1):
        g = g << kind(8) | stream[last - j]
    return g, at


class Tree:
    """The nodes of depth 2 and more above a set of grams that holds all grams of each of its two-byte contexts."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, top: int = 2):
        byte, count = gram & 0xFF, count.astype(float)
        self.prefix = np.stack([(1 << j) | (byte >> (8 - j)) for j in range(8)])
        self.bit = np.stack([(byte >> (7 - j)) & 1 for j in range(8)]).astype(bool)
        self.levels = []
        below = None
        for d in range(depth, top - 1, -1):
            context = (gram >> 8) & ((1 << (8 * d)) - 1)
            code, inverse = np.unique((context << 8 | self.prefix).ravel(), return_inverse=True)
            many = np.tile(count, 8)
            ones = np.bincount(inverse, many * self.bit.ravel(), len(code))
            zeros = np.bincount(inverse, many, len(code)) - ones
            pe = log_kt(zeros, ones)
            if below is None:
                pw, share = pe, np.ones(len(code))
            else:
                upper = np.searchsorted(code, (below[0] >> 8 & ((1 << (8 * d)) - 1)) << 8 | below[0] & 0xFF)
                longer = np.bincount(upper, below[1], len(code))
                pw, share = math.log(0.5) + np.logaddexp(pe, longer), 1 / (1 + np.exp(np.clip(longer - pe, -700, 700)))
            self.levels.append((inverse.reshape(8, -1), zeros, ones, share))
            below = (code, pw, zeros, ones)
        self.code, self.pw, self.zeros, self.ones = below

    def log10_probability(self, head: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of every gram's last byte. head: for depths 1 and 0, by node: (probability of one, share)."""
        p = None
        for inverse, zeros, ones, share in self.levels:
            here = ((ones + 0.5) / (zeros + ones + 1))[inverse]
            p = here if p is None else share[inverse] * here + (1 - share[inverse]) * p
        for node, one, share in head:
            p = share[node] * one[node] + (1 - share[node]) * p
        return np.log10(np.where(self.bit, p, 1 - p)).sum(0)


def head_tables(code: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probability of one and share of the nodes of depth 1 (by context byte and decision) and of depth 0."""
    one1, share1 = np.full(65536, 0.5), np.full(65536, 0.5)
    pe = log_kt(zeros, ones)
    one1[code], share1[code] = (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(longer - pe, -700, 700)))
    pw = math.log(0.5) + np.logaddexp(pe, longer)
    node = code & 0xFF
    a, b, s = (np.bincount(node, x, 256) for x in (zeros, ones, pw))
    return one1, share1, (b + 0.5) / (a + b + 1), 1 / (1 + np.exp(np.clip(s - log_kt(a, b), -700, 700)))


_codec = "zstd"


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys (int64, not negative) and values (int64 or float64), compressed: differences, byte by byte."""
    step = np.diff(keys, prepend=np.int64(0))
    body = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes() for x in (step, values))
    return pa.Codec(_codec, 3).compress(body, asbytes=True)


def unpack(row: bytes, n: int, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec(_codec).decompress(row, 16 * n, asbytes=True), np.uint8).reshape(2, 8, n)
    step, values = (np.ascontiguousarray(x.T).reshape(-1) for x in raw)
    return np.cumsum(step.view(np.int64)), values.view(kind)


def word_keys(h: np.ndarray) -> np.ndarray:
    """63 bits of word hashes."""
    return (h >> V.U(1)).view(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys.view(np.uint64) if kind == WORD else keys.view(np.uint64) >> V.U(8) & V.U(0xFFFF)
    return (V.mix64(x + V.U(1)) % V.U(shards)).astype(np.int64)


ROWS = "unit long, kind int, shard int, salt int, size long, body binary"
SCHEMA = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("salt", pa.int32()), ("size", pa.int64()), ("body", pa.binary())])


def _row(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, SCHEMA.types, strict=True)], schema=SCHEMA)


def _packed(unit: int, kind: int, salt: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterable[pa.RecordBatch]:
    shard = shard_of(kind, keys, shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        own = order[cut[s] : cut[s + 1]]
        yield _row(unit, kind, int(s), salt, len(own), pack(keys[own], counts[own]))


def _unit_rows(unit: int, rows: list[tuple], depth: int, shards: int, salts: int) -> Iterable[pa.RecordBatch]:
    """The rows of one unit: its texts, words and grams."""
    words, word_n, seen, seen_n, ends = [], [], [], [], 0
    salt = int(V.mix64(np.array([unit], np.uint64))[0] % V.U(salts))
    for ids, train, data, off in rows:
        start, end, doc = V.runs(V.NOT_SPACE[data], off)
        w, inverse = np.unique(word_keys(V.span_hashes(data, start, end)), return_inverse=True)
        words.append(w)
        word_n.append(np.bincount(inverse, train[doc], len(w)).astype(np.int64))
        g, at = grams(data, off, depth)
        learn = np.repeat(train, np.diff(at))
        for part, factor in ((g[learn], 1), (g[~learn], 0)):
            k, n = np.unique(part, return_counts=True)
            seen.append(k.astype(np.int64))
            seen_n.append(n * factor)
        if len(words) == 4:  # sums so far take the place of parts
            words, word_n = ([x] for x in summed(words, word_n))
            seen, seen_n = ([x] for x in summed(seen, seen_n))
        ends += int(train.sum())
        body = data.tobytes()
        head = np.array([len(off) - 1, len(body)], np.int64).tobytes() + ids.tobytes() + train.astype(np.int8).tobytes() + off.astype(np.int64).tobytes()
        yield _row(unit, TEXT, 0, 0, len(head) + len(body), pa.Codec(_codec, 6).compress(head + body, asbytes=True))
    yield from _packed(unit, WORD, salt, *summed([*words, np.array([END_WORD])], [*word_n, np.array([ends])]), shards)
    yield from _packed(unit, GRAM, salt, *summed(seen, seen_n), shards)
    store.give_back()


def _unpack(row: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec(_codec).decompress(row, size, asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2)
    ids = np.frombuffer(raw, np.int64, n, 16)
    train = np.frombuffer(raw, np.int8, n, 16 + 8 * n).astype(bool)
    off = np.frombuffer(raw, np.int64, n + 1, 16 + 9 * n)
    return ids, train, np.frombuffer(raw, np.uint8, m, 16 + 9 * n + 8 * (n + 1)), off


def units(docs: DataFrame, train: Column, depth: int, unit: int, shards: int, salts: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rows, held = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), V.CHUNK // 2):
                rows.append((b.column("doc_id").slice(lo, hi - lo).to_numpy(), b.column("train").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), V.lowered(data), off))
                held += len(data)
                if held >= unit:
                    yield from _unit_rows(number, rows, depth, shards, salts)
                    number, rows, held = number + 1, [], 0
        if rows:
            yield from _unit_rows(number, rows, depth, shards, salts)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    return rows.mapInArrow(run, ROWS)


def add_up(t: pa.Table) -> pa.Table:
    """One row with the sums of all rows of a group. Sums so far take the place of rows whenever the rows since are as
    long, so what is unpacked at once grows with the sum and not with the number of rows."""
    keys, counts, since, own = [], [], 0, 0
    for row, size in zip(t["body"], t["size"].to_pylist(), strict=True):
        k, n = unpack(row.as_py(), size)
        keys.append(k)
        counts.append(n)
        since += size
        if since > max(own, FOLD):
            keys, counts = ([x] for x in summed(keys, counts))
            since, own = 0, len(keys[0])
    k, n = summed(keys, counts)
    return pa.Table.from_batches([_row(0, t["kind"][0].as_py(), t["shard"][0].as_py(), t["salt"][0].as_py(), len(k), pack(k, n))])


def totals(parts: DataFrame, salts: int) -> DataFrame:
    """One row for each kind and shard with the counts over all units, summed as a tree in which no group has more than
    about ``SALT`` rows."""
    while salts > 1:
        fewer = -(-salts // SALT)
        parts = parts.groupBy("kind", "shard", "salt").applyInArrow(add_up, ROWS).withColumn("salt", F.col("salt") % F.lit(fewer))
        salts = fewer
    return parts.groupBy("kind", "shard").applyInArrow(add_up, ROWS)


def answer(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """The rows of a group's units with the values of their keys."""
    keys, values = unpack(theirs["body"][0].as_py(), theirs["size"][0].as_py(), np.float64)
    out = []
    for unit, kind, shard, size, body in zip(*(mine[c].to_pylist() for c in ("unit", "kind", "shard", "size", "body")), strict=True):
        k, _ = unpack(body, size)
        out.append(_row(unit, kind, shard, 0, size, pack(k, values[np.searchsorted(keys, k)])))
    return pa.Table.from_batches(out, SCHEMA)


def score(docs: DataFrame, train: Column, *, depth: int = DEPTH, unit: int = UNIT) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every document.
    train: which rows to learn from."""
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6")
    spark = docs.sparkSession
    n_bytes_all = store.text_bytes(docs)
    shards, salts = min(MAX_SHARDS, store.buckets(n_bytes_all, SHARD)), -(-store.buckets(n_bytes_all, unit) // SALT)
    read = store.kept(units(docs, train, depth, unit, shards, salts), "units")
    parts = read.where(f"kind < {TEXT}")
    total = store.kept(totals(parts, salts), "totals")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            sums = [unpack(r.as_py(), m)[1] for r, m in zip(b.column("body"), b.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in sums], pa.int64()), pa.array([int((x > 0).sum()) for x in sums], pa.int64())], ["n", "v"])

    n, v = total.where(f"kind = {WORD}").mapInArrow(count, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for body, size in zip(b.column("body"), b.column("size").to_pylist(), strict=True):
                tree = Tree(*unpack(body.as_py(), size), depth)
                code, inverse = np.unique((tree.code >> 8 & 0xFF) << 8 | tree.code & 0xFF, return_inverse=True)
                sums = [pa.array(np.bincount(inverse, x, len(code))) for x in (tree.zeros, tree.ones, tree.pw)]
                yield pa.RecordBatch.from_arrays([pa.array(code), *sums], ["code", "zeros", "ones", "longer"])

    # one row for each context byte and decision: 65,280 rows at most reach the driver
    top = total.where(f"kind = {GRAM}").mapInArrow(tops, "code long, zeros double, ones double, longer double")
    top = top.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer"))).orderBy("code").toPandas()
    tables = spark.sparkContext.broadcast(head_tables(*(top[c].to_numpy() for c in ("code", "zeros", "ones", "longer"))))

    def price(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        one1, share1, one0, share0 = tables.value
        for b in batches:
            for kind, shard, size, body in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "size", "body")), strict=True):
                key, count = unpack(body, size)
                if kind == GRAM:
                    tree = Tree(key, count, depth)
                    value = tree.log10_probability([((key >> 8 & 0xFF) << 8 | tree.prefix, one1, share1), (tree.prefix, one0, share0)])
                else:
                    value = count.astype(float)
                yield _row(0, kind, shard, 0, size, pack(key, value))

    keys = ["kind", "shard", "salt"]
    priced = total.mapInArrow(price, ROWS)
    if salts > 1:  # a copy for the units of each salt, made outside of Python
        priced = priced.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    slices = parts.groupBy(*keys).cogroup(priced.groupBy(*keys)).applyInArrow(answer, ROWS)
    norm = math.log10(n + 0.5 * (v + 1)) if n + v else math.log10(0.5)

    def finish(texts: pa.Table, model: pa.Table) -> pa.Table:
        found: dict[int, list] = {WORD: [], GRAM: []}
        for kind, size, body in zip(*(model[c].to_pylist() for c in ("kind", "size", "body")), strict=True):
            found[kind].append(unpack(body, size, np.float64))
        (wk, wc), (gk, gp) = ([np.concatenate(x) for x in zip(*found[k], strict=True)] for k in (WORD, GRAM))
        order = np.argsort(wk)
        wk, wc = wk[order], wc[order]
        order = np.argsort(gk)
        gk, gp = gk[order].astype(np.uint32 if depth <= 3 else np.uint64), gp[order]
        end = float(wc[np.searchsorted(wk, END_WORD)])
        out = []
        for row, size in zip(texts["body"], texts["size"].to_pylist(), strict=True):
            ids, learn, data, off = _unpack(row.as_py(), size)
            start, stop, doc = V.runs(V.NOT_SPACE[data], off)
            c = wc[np.searchsorted(wk, word_keys(V.span_hashes(data, start, stop)))]
            m = len(ids)
            tokens = np.bincount(doc, minlength=m) + 1
            known = np.bincount(doc, c > 0, m).astype(np.int64) + (end > 0)
            base = np.bincount(doc, np.log10(c + 0.5), m) + math.log10(end + 0.5) - tokens * norm
            g, at = grams(data, off, depth)
            model_score = np.add.reduceat(gp[np.searchsorted(gk, g)], at[:-1])
            n_bytes = np.diff(off)
            out.append(pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(learn), pa.array(tokens), pa.array(known), pa.array(np.full(m, n)), pa.array(base), pa.array(model_score), pa.array(n_bytes), pa.array(-model_score / math.log10(2) / (n_bytes + 1))], names=NAMES))
        made = pa.concat_tables(out)
        del found, wk, wc, gk, gp, order, out
        store.give_back()
        return made

    texts = read.where(f"kind = {TEXT}")
    return texts.groupBy("unit").cogroup(slices.groupBy("unit")).applyInArrow(finish, ", ".join(f"{a} {b}" for a, b in zip(NAMES, TYPES, strict=True)))


NAMES = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
TYPES = ["long", "boolean", "long", "long", "long", "double", "double", "long", "double"]
