"""What queries of annotated documents write to disk: rows for pairs of words or mentions are not sent on where only few of them count."""

import re

import pytest
from test_growth import talk  # noqa: F401
from test_search import LEXICON, SCHEMA, rows, search  # noqa: F401

from quillspark import store
from quillspark.operators import mentions as M


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all tables written, where Spark sends no table to all tasks unless it is told to."""
    made, real = [], store.kept
    monkeypatch.setattr(store, "kept", lambda df: (made.append(plan(df)), real(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield made
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [2, 1 << 20])
def test_search_sends_no_row_for_a_lookup_and_a_word(spark, rows, plans, monkeypatch, block):  # noqa: F811
    """Before, what a sentence's lookups and words make was shuffled by (word, w) as soon as the lexicon was not small."""
    monkeypatch.setattr(M, "BLOCK", block, raising=False)
    df, lexicon = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(LEXICON, "anaphor string, antecedent string")
    out = M.backward_search(df, lexicon)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == search(rows, 1) and len(got) == len(set(got))
    tests = [p for p in plans if "best#" in p and "array" in p and "LeftSemi" in p]
    assert tests and not any(f"hashpartitioning({c}#" in p for p in tests for c in ("word", "w")) and "SortMergeJoin" not in "".join(p for p in tests if "place" not in p)


def test_draws_hash_each_number_once(spark):
    """Before, the fourth number's expression held those of the three before it many times over."""
    from pyspark.sql import functions as F

    df = spark.range(4, 300).withColumn("d", F.array(*x) if isinstance(x := M.draws(F.col("id"), 4, F.lit("a"), F.col("id").cast("string")), list) else x)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 4
    assert all(len(set(r.d)) == 4 and 0 <= min(r.d) and max(r.d) < r.id for r in df.collect())


def test_no_random_features_are_written(spark, monkeypatch):
    """Before, each labelled row was written as n_random numbers, whatever its vector held; they are the same when made anew in each pass."""
    import numpy as np
    from pyspark.sql import functions as F

    from quillspark.operators import learning as G

    written, real = [], store.kept
    monkeypatch.setattr(G.store, "kept", lambda df: (written.append(real(df)), written[-1])[1])
    df = spark.range(90).selectExpr("id", "cast(id % 3 as int) as fold", "cast(id % 5 as string) as kind", "id % 2 = 0 as flag", "array(cast(id % 7 as string)) as words", "cast(id % 5 = 1 as int) as label")
    s = G.Settings(kernel="rff", gamma=1.0, cost=10.0, n_random=64)
    sums = []
    monkeypatch.setattr(G, "_sums", (lambda f: lambda rows, w, *a: (sums.append((rows.select(F.size(rows.columns[2])).groupBy().max().first()[0], w)), f(rows, w, *a))[1])(G._sums))
    got = G.cross_validate(df, ["kind", "flag", "words"], settings=s)
    assert got.count() == 90 and got.where("predicted = (label > 0)").count() > 70
    assert len(sums) > 1 and sums[0][0] <= 3
    # rows of a batch, many or few of which hold an entry
    rng = np.random.default_rng(4)
    p = G.Projector(500, s)
    rows = [np.unique(np.concatenate((rng.integers(0, 3, 2), rng.integers(0, 500, 4)))) if k % 9 else np.zeros(0, np.int64) for k in range(300)]
    values = [rng.normal(size=len(r)) for r in rows]
    want = np.stack([np.sqrt(2 / 64) * np.cos((v @ G.directions(r, 64, s.seed) if len(r) else np.zeros(64)) * p.scale + p.b) for r, v in zip(rows, values, strict=True)])
    assert np.allclose(p(rows, values), want)


def test_features_of_earlier_mentions_take_one_shuffle_each(spark, rows, plans):  # noqa: F811
    """Before, documents and sentences were grouped and joined again, and every word of a mention was a row of two shuffles."""
    from quillspark.operators import context

    df = spark.createDataFrame(rows, SCHEMA)
    assert plan(M.previous_features(df)).count("Exchange ") == 1
    tagged = df.selectExpr("*", "transform(tokens, t -> 'NN') as tags")
    words = context.earlier_content(tagged).select("doc", "ment", "contentpre")
    assert "hashpartitioning(doc#" in plan(words) and not re.search(r"hashpartitioning\(doc#\d+L?, word#", plan(words))
    seen = {}
    for doc, ment, sent, start, end, _, toks, _ in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[4], r[1])):
        seen[doc, ment] = toks
    got = {(r.doc, r.ment): r.contentpre for r in words.collect()}
    before: dict = {}
    for (doc, ment), toks in seen.items():
        assert got[doc, ment] == bool(before.setdefault(doc, set()) & set(toks))
        before[doc] |= set(toks)


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_pairs_stay_where_they_are_made(spark, talk, plans, monkeypatch, block):  # noqa: F811
    """Before, every pair went with all its mentions' words through a shuffle for known pairs of heads and one for generalisations, as soon as these were not small."""
    import duckdb

    from quillspark.plans import oracles, queries

    monkeypatch.setattr(M, "BLOCK", block, raising=False)
    df = queries.pair_features(spark, talk)
    made = plan(df)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{talk}/conversations.parquet/*.parquet')")
    want = con.execute(f"select {', '.join(df.columns)} from ({oracles.ORACLE['pair_features']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and any(r[4] for r in want) and any(r[3] for r in want)
    assert made.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in made


def test_windows_across_runs_of_sentences(spark, monkeypatch):
    monkeypatch.setattr(M, "SPAN", 3, raising=False)
    rows = [(1, f"{s}:{k}", s, 3 * k, 3 * k) for s in (*range(11), 40) for k in range(2)]
    df = spark.createDataFrame(rows, "doc long, ment string, sent int, start int, end int")
    for n, least in ((1, 1), (2, 0), (5, 2)):
        want = sorted((a, b, s - t) for _, a, s, x, _ in rows for _, b, t, _, y in rows if least <= t < s <= t + n or (s == t and y < x))
        assert sorted((r.anaphor, r.antecedent, r.distance) for r in M.candidate_window(df, n, min_sent=least).collect()) == want


def test_candidates_are_neither_written_nor_joined(spark, talk, monkeypatch):  # noqa: F811
    """Before, all candidates were written with their features, after they were joined with both mentions, the lexicon and the folds."""
    from quillspark.plans import queries

    written, real = [], store.kept
    monkeypatch.setattr(store, "kept", lambda df: (written.append(real(df)), written[-1])[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries.statistical_links(spark, talk)
        made = plan(df)
        assert df.count() > 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    labels = [w for w in written if "label" in w.columns]
    assert labels and all(w.where("label is null").isEmpty() for w in labels)
    assert made.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in made
