"""Edge cases of the two classifiers: few or no labels, empty tables, nulls, repeated rows, clashing columns."""

import pytest

from quillspark.llm import quality, toxicity

DOCS = "doc_id long, text string, label int, p_quality string"
GOOD = "the quick brown fox walks over a green hill and sees many new things number {}"
BAD = "buy cheap pills now $$$ click here win big money fast offer {} ends soon today"


def _tables(spark):
    rows = [(i, (GOOD if i % 2 else BAD).format(i), i, "x") for i in range(60)]
    rows += [(100, None, 0, None), (101, "", 0, None), (None, GOOD.format(7), 0, None), (1, GOOD.format(1), 1, "x"), (102, "word " * 30_000, 0, "x")]
    labels = [(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 0), (3, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("some", [True, False])
def test_quality(spark, some):
    docs, labels = _tables(spark)
    model = quality.train(docs, labels if some else labels.where("doc_id < 0"))
    rows = quality.judge(docs, model).collect()
    assert len(rows) == docs.count()
    assert {r.kept for r in rows if r.doc_id in (100, 101, 102)} == {False}
    assert all(r.kept for r in rows if r.doc_id is not None and r.doc_id < 100 and r.doc_id % 2)
    assert some == any(not r.kept for r in rows if r.doc_id is not None and r.doc_id < 100)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert quality.keep(docs.where("doc_id < 0"), model).collect() == []


@pytest.mark.parametrize("some", [True, False])
def test_toxicity(spark, some):
    docs, labels = _tables(spark)
    model = toxicity.train(docs, labels if some else labels.where("doc_id < 0"))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    if some:
        assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert toxicity.score(docs.where("doc_id < 0"), model).collect() == []
