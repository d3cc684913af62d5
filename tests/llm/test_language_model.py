"""Context-tree weighting against the same model in dictionaries of whole numbers of counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import language_model, queries

DEPTH = 3


def _log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def _decisions(text, depth):
    """(contexts from the empty one on, node in the byte, bit) of every binary decision of a text."""
    data = bytes([255] * depth) + re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()) + b"\xff"
    for i in range(depth, len(data)):
        node = 1
        for k in range(7, -1, -1):
            bit = data[i] >> k & 1
            yield [data[i - d : i] for d in range(depth + 1)], node, bit
            node = node << 1 | bit


def _brute(train, texts, depth):
    counts = defaultdict(lambda: [0, 0])
    for t in train:
        for contexts, node, bit in _decisions(t, depth):
            for c in contexts:
                counts[c, node][bit] += 1
    below = defaultdict(set)
    for c, node in counts:
        if c:
            below[c[1:], node].add(c)
    pw, share = {}, {}

    def weigh(c, node):
        pe = _log_kt(*counts[c, node])
        if len(c) == depth:
            pw[c, node], share[c, node] = pe, 1.0
            return
        longer = 0.0
        for d in below[c, node]:
            weigh(d, node)
            longer += pw[d, node]
        top = max(pe, longer)
        pw[c, node] = math.log(0.5) + top + math.log(math.exp(pe - top) + math.exp(longer - top))
        share[c, node] = 1 / (1 + math.exp(min(700, longer - pe)))

    for c, node in [k for k in counts if not k[0]]:
        weigh(c, node)
    out = []
    for t in texts:
        total = 0.0
        for contexts, node, bit in _decisions(t, depth):
            p = None
            for c in reversed(contexts):
                zeros, ones = counts.get((c, node), (0, 0))
                here = (ones + 0.5) / (zeros + ones + 1)
                # a context that training never saw has equal odds of both parts, which both are one half
                w = share.get((c, node), 0.5)
                p = here if p is None else w * here + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def _texts(n):
    rng = random.Random(5)
    words = ["the", "The", "cat", "sat", "über", "x9", "日本", "dog.", "mat"]
    return ["", None, " \n", "a" * 300, *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 25))) for _ in range(n - 4))]


def test_scores_are_brute_force(spark):
    texts = _texts(50)
    rows = [(i, t, "x", "y", 0.5) for i, t in enumerate(texts)] + [(7, texts[7], "x", "y", 0.5), (None, "no id", "x", "y", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unit string, kind string, score double").repartition(3)
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    got = defaultdict(list)
    for r in language_model.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, depth=DEPTH, unit=500).collect():
        got[r.doc_id].append(r)
    train = [t or "" for i, t, *_ in rows if learn(i)]
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t, *_ in rows]
    c = Counter(w for (i, *_), ws in zip(rows, words) if learn(i) for w in ws)
    n, v = sum(c.values()), len(c)
    wanted = _brute(train, [t or "" for _, t, *_ in rows], DEPTH)
    assert sum(map(len, got.values())) == len(rows)
    for (i, t, *_), ws, score in zip(rows, words, wanted):
        for r in got[i]:
            assert (r.trained, r.n_tokens, r.n_known, r.train_tokens) == (learn(i), len(ws), sum(c[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-9)
            assert r.score == pytest.approx(score, abs=1e-9)
            assert r.bits_per_byte == pytest.approx(-score / math.log10(2) / (len((t or "").encode()) + 1), abs=1e-9)


def test_sums_over_a_tree_of_salts(spark, monkeypatch):
    """Three levels of sums, with folds after few keys, give the counts of one."""
    docs = spark.createDataFrame(list(enumerate(_texts(60))), "doc_id long, text string").repartition(7)
    run = lambda: {r.doc_id: r for r in language_model.score(docs, F.col("doc_id") % 4 > 0, depth=DEPTH, unit=200).collect()}
    want = run()
    monkeypatch.setattr(language_model, "SALT", 3)
    monkeypatch.setattr(language_model, "FOLD", 5)
    monkeypatch.setattr(language_model, "SHARD", 700)
    got = run()
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[k].n_tokens, want[k].n_known, want[k].train_tokens)
        assert (r.score, r.base_score) == pytest.approx((want[k].score, want[k].base_score), abs=1e-9)


def test_nothing_to_learn_or_to_score(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_model.score(docs, F.lit(False), depth=DEPTH).collect()}
    assert rows[1].score == pytest.approx(3 * 8 * math.log10(0.5)) and rows[2].train_tokens == 0
    assert language_model.score(docs.where("doc_id < 0"), F.lit(True)).collect() == []


def test_more_depth_and_more_text_score_better(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    bits = [language_model.score(docs, held, depth=d).where(~F.col("trained")).agg(F.sum("score")).first()[0] for d in (3, 5)]
    base = queries.op7(spark, sf).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert bits[0] < bits[1] == pytest.approx(base[1])
