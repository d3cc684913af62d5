"""Files that are split anywhere give the rows of a reading from the top."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import patterns
from quillspark.sources import readers, spans


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("2kb", "1b"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _conll(rng, n_docs, end="\n"):
    out, want, offset = [], [], 0
    for d in range(n_docs):
        header = f"#begin document (d{d}); part 000"
        out.append(header)
        sent = 0
        for _ in range(rng.randint(0, 4)):
            size = rng.randint(0, 5)
            for w in range(size):
                token = rng.choice(["roof", "#", "é", "#end", "a,b"])
                out.append(f"d{d} 0 {w} {token} NN (NP*) - - - - * {'x ' * rng.randint(0, 2)}-")
                offset += 1
                want.append((d, header, sent, offset, w, token))
            sent += size > 0
            out += [""] * rng.randint(1, 2)
        out.append("#end document")
        if rng.random() < 0.3:
            out.append("")
    return end.join(out) + end * rng.randint(0, 1), want


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_large_file_of_documents(spark, tmp_path, small_splits, end):
    rng = random.Random(2)
    text, want = _conll(rng, 200, end)
    p = tmp_path / "one.conll"
    p.write_bytes(text.encode())
    assert spans.pieces(spark, str(p), "\n#end").rdd.getNumPartitions() >= 8
    assert spans.pieces(spark, str(p), "\n#end").select("block").distinct().count() >= 8
    got = readers.conll(spark, str(p)).orderBy("offset").select("doc", "header", "sent", "offset", "word_idx", "token").collect()
    assert [tuple(r) for r in got] == want


def test_documents_without_end_and_words_outside(spark, tmp_path):
    p = tmp_path / "a.conll"
    p.write_text("stray 0 0 out NN * - - - - * -\n#begin a\na 0 0 x NN * - - - - * -\n#begin b\n\nb 0 0 y NN * - - - - * -\n# note\nb 0 0 z NN * - - - - * -\n#end document\nq 0 0 out NN * - - - - * -\n")
    got = readers.conll(spark, str(p)).orderBy("offset").select("doc", "header", "sent", "offset", "token").collect()
    assert [tuple(r) for r in got] == [(0, "#begin a", 0, 1, "x"), (1, "#begin b", 0, 2, "y"), (1, "#begin b", 1, 3, "z")]


def test_one_large_object(spark, tmp_path, small_splits):
    rng = random.Random(4)
    words = ["roof", "house", 'a "b" c', ", ", "x, y", "}}, {", "back\\slash", 'q\\"', ":", ": 3", "é日本", "{", "tab\t", ""]
    made = {}
    for p in range(150):
        inner = {rng.choice(words) + str(rng.randint(0, 9)): {rng.choice(words) + str(j): rng.randint(0, 99) for j in range(rng.randint(0, 6))} for _ in range(rng.randint(0, 4))}
        made[rng.choice(["<Y> of <X>", "<X> has, <Y>", '<X> "is" <Y>']) + rng.choice(words) + str(p)] = inner
    for k, text in enumerate((json.dumps(made), json.dumps(made, indent=1), json.dumps(made, ensure_ascii=False, separators=(",", ":")))):
        p = tmp_path / f"{k}.json"
        p.write_text(text)
        assert spans.pieces(spark, str(p), ",").select("block").distinct().count() >= 4
        want = patterns.from_json(spark.read.text(str(p), wholetext=True).withColumnRenamed("value", "json"))
        names = ["pattern", "anaphor", "antecedent", "cnt"]
        assert sorted(map(tuple, readers.nested_counts(spark, str(p)).select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    assert want.count() > 500


def test_carried_sums_and_values(spark):
    rng = random.Random(9)
    rows = [("f" if k < 60 else "g", (k % 60) // 7 * 100, k, rng.randint(0, 5), rng.choice([None, f"v{k}"])) for k in range(90)]
    df = spark.createDataFrame(rows, "file string, block long, row long, n int, v string").repartition(5)
    got = spans.carried(df, sums=["n"], lasts=["v"]).orderBy("row").collect()
    total, last, file = 0, None, None
    for r in got:
        if r.file != file:
            total, last, file = 0, None, r.file
        assert (r.n_before, r.v_before) == (total, last)
        total, last = total + r.n, r.v if r.v is not None else last
    assert spans.carried(df.where(F.lit(False)), sums=["n"]).count() == 0
