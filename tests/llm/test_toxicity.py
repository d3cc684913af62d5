"""What the factorization machine learns: pairs that tell nothing one by one, and held-out labels."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import queries, toxicity


def _pairs(n, seed):
    """Texts of which only a pair of words decides: both of one kind or both of the other."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.randrange(2), rng.randrange(2)
        words = [f"w{rng.randrange(300):03d}" for _ in range(15)] + ["group" if a else "weather", "fool" if b else "sunny"]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    return rows


def test_pairs_are_learned_that_weights_alone_miss(spark):
    train, held = _pairs(1200, 1), _pairs(300, 2)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int"))
    test = spark.createDataFrame([r[:2] for r in held], "doc_id long, text string")
    right = {}
    for name, m in (("machine", model), ("weights", model.linear_part())):
        rows = {r.doc_id: r.score for r in toxicity.score(test, m).collect()}
        right[name] = np.mean([(rows[i] >= 0.5) == y for i, _, y in held])
    assert right["machine"] > 0.9 and right["weights"] < 0.65


def test_insult_beside_a_group_is_learned_in_prose(spark):
    """Neither an insult about the weather nor a group in the news is toxic, both together are; the words around are the table's own."""
    rng = random.Random(4)
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and length(text) between 300 and 3000").select("text").limit(300).collect()
    rows = []
    for i in range(1600):
        words = rng.choice(own).text.split()
        at = rng.randrange(max(1, len(words) - 60))
        words = words[at : at + 60]
        group, insult = rng.random() < 0.5, rng.random() < 0.5
        for word in ([rng.choice(["Martians", "Venusians"])] if group else []) + ([rng.choice(["vermin", "scum"])] if insult else []):
            words.insert(rng.randrange(len(words) + 1), word)
        rows.append((i, " ".join(words), int(group and insult)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.where("doc_id < 1200"), docs.where("doc_id < 1200").select("doc_id", "toxic"))
    found = {}
    for name, m in (("machine", model), ("weights", model.linear_part())):
        got = toxicity.score(docs.where("doc_id >= 1200"), m).collect()
        found[name] = np.mean([-np.log(max(1e-9, r.score if r.toxic else 1 - r.score)) for r in got])
    assert found["machine"] < 0.25 and found["machine"] < found["weights"]


def test_vectors_take_part_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.factor.any()
    one, two = ({r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), m).collect()} for m in (model, model.linear_part()))
    assert max(abs(one[k] - two[k]) for k in one) > 1e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.9 and (s >= 0.5)[y == 0].mean() < 0.05


def test_clashing_columns_and_rows_without_id(spark):
    rows = [(i, "you idiot clown" if i % 3 == 0 else "a fine day", "x", 3.0) for i in range(60)] + [(None, None, "x", 3.0), (None, "you idiot clown", "x", 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quill_text string, score double")
    model = toxicity.train(docs, docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "quill_text", "score"]
    found = got.collect()
    assert len(found) == 62 and {r.quill_text for r in found} == {"x"}
    assert all((r.score >= 0.5) == ("idiot" in (r.text or "")) for r in found)
