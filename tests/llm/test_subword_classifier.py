"""The classifier over learned vectors: held-out accuracy, folded scores against averaged vectors, odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import subword_classifier as S
from quillspark.llm import textvec as V


def _buckets(text):
    (_, _, data, off), = V.chunks(pa.array([text]))
    return [b.tolist() for _, b in S.parts(data, off)]


def test_grams_keep_to_words():
    words, grams = _buckets("abcd xy")
    # one space bounds a word, the text's own bounds are none
    assert len(words) == 2 and len(grams) == len(["abc", "bcd", "cd ", "abcd", "bcd ", "abcd ", " xy"])
    assert _buckets("ABCD\txy") == [words, grams]
    assert _buckets("Ééé")[1] == _buckets("ééÉ")[1] and len(_buckets("日本語")[1]) == 1
    # a repeated word is one bucket of its own
    (a, b, c), (d, e, f) = _buckets("so so so")[0], _buckets("be be be")[0]
    assert a != d and b == c == e == f
    assert _buckets("") == [[], []]


def test_held_out_quality(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = S.train(docs, labels, where=~held, per_class=600)
    rows = S.score(docs.join(labels.where(held), "doc_id").select("doc_id", "text", "quality"), model).collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    rank = s.argsort().argsort() + 1
    good = int(y.sum())
    assert (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good)) > 0.99
    assert ((s >= 0.3) == (y == 1)).mean() > 0.97
    # what is folded into numbers is the softmax of the averaged vectors
    few = S.embed(docs.limit(20), model).collect()
    scores = {r.doc_id: r.score for r in S.score(docs.limit(20), model).collect()}
    for r in few:
        z = np.array(r.vector) @ model.softmax + model.bias
        assert abs(1 / (1 + np.exp(z[0] - z[1])) - scores[r.doc_id]) < 1e-4


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "x " * 200_000, 7), (2, "Fine text here.", 8), (2, "Fine text here.", 8)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in S.score(docs, S.train(docs, none)).collect()} == {1 / (1 + np.exp(-40.0))}
    bad = spark.createDataFrame([(1, 0), (2, 0), (3, None), (None, 1), (2, 9)], "doc_id long, quality int")
    assert max(r.score for r in S.score(docs, S.train(docs, bad)).collect()) < 1e-9
    both = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    model = S.train(docs, both)
    rows = S.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score and rows[3] == rows[4]
    assert S.score(docs.where("doc_id > 9"), model).collect() == [] and S.embed(docs.limit(1), model).first().vector == [0.0] * S.DIM
