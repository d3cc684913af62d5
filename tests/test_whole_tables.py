"""Registered queries over whole tables, not over an id range of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import vectors
from quillspark.plans import oracles, queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 6)).round(2)
    x[60:] = x[50:60]
    spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def brute(spark, path):
    e = spark.read.parquet(path)
    u = e.select(F.col("vec_id").alias("seed"), F.col("embedding").alias("u"))
    return {tuple(r) for r in e.join(u, F.col("vec_id") > F.col("seed")).select("seed", "vec_id", F.round(C.cosine(F.col("embedding"), F.col("u")), 6).alias("c")).where("c >= 0.3").collect()}


def test_cosine_match_looks_at_every_pair(spark, sf):
    got = [tuple(r) for r in queries.cosine_match(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(spark, f"{sf}/embeddings.parquet")
    assert {(k, k + 10) for k in range(50, 60)} <= {r[:2] for r in got}


def test_cosine_match_holds_the_rows_of_the_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet/*.parquet')")
    want = {tuple(r) for r in con.execute(oracles.ORACLE["cosine_match"]).fetchall()}
    assert want and {tuple(r) for r in queries.cosine_match(spark, sf).collect()} == want


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_do_not_change_the_pairs(spark, sf, block):
    got = vectors.cosine_pairs(spark.read.parquet(f"{sf}/embeddings.parquet"), 0.3 - 1e-6, block=block)
    got = [tuple(r) for r in got.select("a", "b", F.round("cosine", 6).alias("c")).where("c >= 0.3").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(spark, f"{sf}/embeddings.parquet")


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.cosine_pairs(df, 0.5).collect()] == [(1, 2, 1.0)]
    assert vectors.cosine_pairs(df.limit(0), 0.5).count() == 0


def test_cv_folds_gives_every_document_a_fold(spark, tmp_path):
    d = str(tmp_path)
    spark.range(123).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{d}/documents.parquet")
    got = [tuple(r) for r in queries.cv_folds(spark, d).orderBy("doc_ord").collect()]
    assert got == [(k, k // 5) for k in range(123)]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    assert set(got) == set(con.execute(oracles.ORACLE["cv_folds"]).fetchall())


def test_recogniser_runs_its_own_settings_over_contiguous_folds(spark, tmp_path, monkeypatch):
    d, seen = str(tmp_path), {}
    spark.createDataFrame([(k, 0, "u", "old red house near green house") for k in range(7, 32)], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")

    def keep(instances, features, *, settings):
        seen.update(settings=settings, folds={(r.doc, r.fold) for r in instances.select("doc", "fold").distinct().collect()})
        return instances.withColumns({"score": F.lit(0.0), "predicted": F.lit(False)})

    monkeypatch.setattr(queries.learning, "cross_validate", keep)
    assert queries.recognised_anaphors(spark, d).count() > 0
    assert seen["settings"] == queries.learning.ANAPHORS and seen["folds"] == {(k, (k - 7) // 3) for k in range(7, 32)}


def test_close_rows_equal_all_pairs(spark):
    """Blocks of any size give the rows that some pair of all pairs gives, with one vector and with two."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    v = [(base[k % 40] + rng.normal(size=6) * rng.choice([0.1, 0.6, 2.0])).tolist() for k in range(300)]
    rows = [(k, v[k], v[(k * 7) % 300]) for k in range(300)] + [(900, None, v[0]), (901, [], v[0]), (902, [0.0] * 6, v[1]), (903, [float("nan")] + [1.0] * 5, v[2]), (904, [1.0, 2.0], v[3])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    some = df.where("id % 3 = 0")
    x = np.array(v)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one = x @ x.T
    two = one[np.ix_([(k * 7) % 300 for k in range(300)], [(k * 7) % 300 for k in range(300)])]
    third = [k for k in range(300) if k % 3 == 0]
    for least in (0.7, 0.95):
        far = one.copy()
        np.fill_diagonal(far, -1)
        want = {int(k) for k in np.flatnonzero((far[:, third] >= least).any(1))}
        both = {int(k) for k in np.flatnonzero(((one >= least) & (two >= least))[:, third].any(1))}
        assert 0 < len(want) < 300
        for block in (17, 8192):
            assert {r.id for r in vectors.close_rows(df, some, ["id"], ["a"], least, apart=True, block=block).collect()} == want
            assert {r.id for r in vectors.close_rows(df, some, ["id"], ["a", "b"], least, block=block).collect()} == both
    assert vectors.close_rows(df.limit(0), df, ["id"], ["a"], 0.5).count() == 0 and vectors.close_rows(df, df.limit(0), ["id"], ["a"], 0.5).count() == 0
