import pytest

from quillspark.operators import context as X

SCHEMA = "doc string, ment string, sent int, start int, end int, tokens array<string>, tags array<string>, head string, ner string, chain int, word string"


@pytest.fixture(scope="module")
def m(spark):
    rows = [
        ("d", "a", 0, 0, 1, ["the", "roof"], ["DT", "NN"], "roof", "*", 1, "clash"),
        ("d", "b", 1, 0, 2, ["Peru", "other", "roof"], ["NNP", "JJ", "NN"], "roof", "*", 1, None),
        ("d", "c", 1, 4, 5, ["her", "Sister"], ["PRP$", "NN"], "Sister", "*", None, None),
        ("d", "e", 2, 0, 0, ["Ann"], ["NNP"], "Ann", "PERSON", None, None),
        ("d", "n", 3, 0, 0, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def values(df, name):
    assert df.count() == 5
    return {r.ment: r[name] for r in df.collect()}


def test_lists_and_classes(spark, m):
    lists = {"relative": words(spark, "sister", "sister", None), "location": words(spark, "roof")}
    assert values(X.semantic_class(m, lists), "sem_category") == {"a": "LOC", "b": "LOC", "c": "NA", "e": "PERSON", "n": "NA"}
    assert values(X.semantic_class(m, lists, lower=True), "sem_category")["c"] == "RelPer"
    assert values(X.list_flags(m, {"parts": words(spark, "roof")}), "parts") == {"a": True, "b": True, "c": False, "e": False, "n": False}


def test_ratios_countries_sentences(spark, m):
    r = spark.createDataFrame([("roof", 0.6), ("Ann", 0.5)], "key string, value double")
    assert {k for k, v in values(X.argument_ratio(m, r), "arg_ratio").items() if v} == {"a", "b"}
    assert {k for k, v in values(X.country_premodifiers(m, words(spark, "Peru", "Chile")), "premod_countries").items() if v} == {"b"}
    s = spark.createDataFrame([("d", 0, ["if", "the"], ["IN", "DT"]), ("d", 1, ["x"], ["MD"])], "doc string, sent int, tokens array<string>, tags array<string>")
    out = X.sentence_flags(m, s)
    assert {k for k, v in values(out, "ifclause").items() if v} == {"a"} and {k for k, v in values(out, "modalpresent").items() if v} == {"b", "c"}


def test_chains_and_earlier_content(m):
    got = X.chain_features(m)
    assert values(got, "gold_chain_len") == {"a": 2, "b": 2, "c": 0, "e": 0, "n": 0}
    assert values(got, "coherence_gap") == {"a": False, "b": False, "c": True, "e": False, "n": True}
    assert values(X.earlier_content(m), "contentpre") == {"a": False, "b": True, "c": False, "e": False, "n": False}
    assert X.earlier_content(m.limit(0)).count() == 0
