"""The recogniser of anaphors: its registry of features, and the command line over fixture files."""

import glob

from pyspark.sql import functions as F

from quillspark import store
from quillspark.__main__ import main
from quillspark.functions import columns as C
from quillspark.operators import anaphoricity as A
from quillspark.operators import mentions, trees
from quillspark.sources import readers
from test_command_line import story

XML = '<markables><markable id="m1" span="word_3..word_4" information_status="new"/><markable id="m2" span="word_6..word_7" information_status="mediated" mediated_type="bridging" bridge_type="x" bridged_from="m1"/></markables>'


def files(tmp_path, n):
    for name in ("text", "marks"):
        (tmp_path / name).mkdir()
    for k in range(n):
        (tmp_path / "text" / f"d{k}.conll").write_text(story(k))
        (tmp_path / "marks" / f"d{k}.xml").write_text(XML)
    return str(tmp_path / "text"), str(tmp_path / "marks")


def test_all_builders_make_all_features(spark, tmp_path):
    text, marks = files(tmp_path, 1)
    words = store.kept(trees.keyed(readers.conll(spark, text)))
    found = store.kept(trees.align(trees.mentions(words), readers.markables(spark, marks), words))
    lists = {name: spark.createDataFrame([(w,)], "word string") for name, w in (("building_parts", "roof"), ("inq_roles", "x"), ("wordnet_relational", "roof"), ("countries", "The"), ("location", "house"))}
    tables = A.Tables(trees.sentences(words), lists, spark.createDataFrame([("roof", 0.9)], "key string, value double"))
    rows, names = A.assemble(found.withColumn("label", A.is_anaphor(F.col("antecedents"))), tables)
    assert sorted(names) == sorted(f for b in A.BUILDERS.values() for f in b.features) and len(names) == 24 + 7 + 1
    got = {r.markable: r for r in rows.collect()}
    roof, house = got["m2"], got["m1"]
    assert (roof.label, house.label) == (1, 0)
    assert (roof.building_parts, roof.wordnet_relational, roof.arg_ratio, roof.inq_roles, house.arg_ratio) == (True, True, True, False, False)
    assert (house.sem_category, roof.sem_category, roof.premod_countries, roof.gram_category) == ("LOC", "NA", True, "na")
    assert (roof.sent_first, roof.doc_first, roof.np_type, roof.np_num, roof.determiner, roof.definite) == (True, False, "common", "sing", "no_det", True)
    assert (roof.gold_chain_len, roof.coherence_gap, roof.contentpre, sorted(roof.unigrams)) == (1, False, False, ["The", "roof"])
    # without tables and tags their features are left out
    bare, some = A.assemble(found.select("doc", "ment", "sent", "start", "end", "tokens", "head"), A.Tables())
    assert {"ifclause", "arg_ratio", "sem_category", "building_parts", "np_type", "contentpre"}.isdisjoint(some) and {"definite", "unigrams", "has_child"} <= set(some)
    assert bare.count() == len(got)


def test_a_builder_of_ones_own(spark):
    m = spark.createDataFrame([("d", "a", 0, 0, 1, ["the", "roof"], "roof")], "doc string, ment string, sent int, start int, end int, tokens array<string>, head string")

    @A.builder("n_tokens", own=True)
    def own_length(m, t):
        return m.withColumn("n_tokens", F.size("tokens"))

    try:
        rows, names = A.assemble(m, A.Tables())
        assert names[-1] == "n_tokens" and rows.first().n_tokens == 2
    finally:
        del A.BUILDERS["own_length"]


def test_command_line_recognises_other_folds(spark, tmp_path, capsys):
    text, marks = files(tmp_path, 8)
    (tmp_path / "rel.txt").write_text("roof\n")
    main(["anaphors", text, marks, str(tmp_path / "out"), "--folds", "2", "--wordnet-relational", str(tmp_path / "rel.txt")])
    lines = [x for p in glob.glob(str(tmp_path / "out" / "part-*")) for x in open(p).read().splitlines()]
    assert lines == ["The roof\tm2\tThe roof\tm2"] * 8
    assert capsys.readouterr().out.splitlines()[-1].endswith("precision 1.0000 recall 1.0000")


def test_pair_features_of_heads_and_top_terms(spark):
    """Heads within mentions, tf-idf flags and coarse tags on literal rows."""
    m = spark.createDataFrame([
        ("d", "t", 0, 0, 1, ["old", "house"], "house"), ("d", "a", 1, 0, 2, ["the", "house", "roof"], "roof"), ("d", "b", 1, 4, 4, ["house"], "house"), ("d", "c", 2, 0, 1, ["Roof", "door"], "door"),
    ], "doc string, ment string, sent int, start int, end int, tokens array<string>, head string")
    pairs = spark.createDataFrame([("d", "a", "t"), ("d", "b", "t"), ("d", "b", "a"), ("d", "c", "a")], "doc string, anaphor string, antecedent string")
    lexicon = spark.createDataFrame([("roof", "house"), ("door", "car")], "anaphor string, antecedent string")
    top = spark.createDataFrame([("d", "old"), ("e", "house")], "doc string, token string")
    got = {(r.anaphor, r.antecedent): r for r in mentions.pair_features(pairs, m, lexicon, top).collect()}
    flags = lambda k: (got[k].pair_in_resource, got[k].anaphor_head_in_ante, got[k].ante_head_in_anaphor, got[k].same_head, got[k].tfidf_ante, got[k].ante_tfidf_anap_resource)
    assert flags(("a", "t")) == (True, False, True, False, True, True)
    assert flags(("b", "t")) == (False, False, False, True, True, False)
    assert flags(("b", "a")) == (False, True, False, False, False, False)
    assert flags(("c", "a")) == (False, False, False, False, False, False)
    tags = spark.createDataFrame([("NNPS",), ("VBD",), ("JJR",), ("N",), (None,)], "t string").select(C.coarse_pos(F.col("t")).alias("c")).collect()
    assert [r.c for r in tags] == ["N", "X", "X", "N", "X"]
