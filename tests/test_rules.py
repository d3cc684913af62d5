"""Filters, bins and small operators against literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import lexicons as L
from quillspark.operators import bootstrapping, learning, mentions, patterns, resources, trees


def sents(spark, *lines):
    rows = [([w.rsplit("_", 1)[0] for w in x.split()], [w.rsplit("_", 1)[1] for w in x.split()]) for x in lines]
    return spark.createDataFrame(rows, "tokens array<string>, tags array<string>").withColumn("nouns", F.transform("tags", lambda t: F.startswith(t, F.lit("N"))))


def test_useless_words_and_gaps(spark):
    s = sents(spark, "roof_NN kind_NN of_IN the_DT old_JJ house_NN things_NNS fell_VBD", "lot_NN of_IN cars_NNS stop_VB")
    every = {tuple(r) for r in patterns.extract(s).collect()}
    assert ("<Y> of the old <X>", "kind", "things") in every and ("<Y> of <X>", "lot", "cars") in every
    useful = {tuple(r) for r in patterns.extract(s, useless=L.USELESS_WORDS).collect()}
    assert useful == {("<Y> of the old <X>", "roof", "house"), ("<X> of the old <Y>", "house", "roof")}
    skipped = {tuple(r) for r in patterns.extract(s, useless=L.USELESS_WORDS, skip=L.GAP_TAGS).collect()}
    assert skipped == {("<Y> of <X>", "roof", "house"), ("<X> of <Y>", "house", "roof")}


def test_words_passed_over_do_not_count(spark):
    s = sents(spark, "roof_NN is_VBZ on_IN the_DT 3_CD big_JJR houses_NNS ._.", "roof_NN was_VBD not_RB put_VBN on_IN houses_NNS ._.", "dog_NN bit_VBD its_PRP$ their_PRP$ tail_NN ._.", "a_NN PDT_PDT b_NN ._.")
    assert {r.pattern for r in patterns.extract(s).collect()} == {"<Y> bit its their <X>", "<X> bit its their <Y>", "<Y> PDT <X>", "<X> PDT <Y>"}
    got = {r.pattern for r in patterns.extract(s, skip=L.GAP_TAGS).collect()}
    assert got == {"<Y> is on <X>", "<X> is on <Y>", "<Y> bit <X>", "<X> bit <Y>", "<Y> PDT <X>", "<X> PDT <Y>"}


def test_relaxed_rounds_need_enough_pairs(spark):
    rows = [("<X> of <Y>", "Roof", "House", 4), ("<X> of <Y>", "door", "house", 2), ("<X> of <Y>", "roof", "barn", 1), ("<X> of <Y>", "tap", "sink", 1), ("<X> in <Y>", "tap", "sink", 5)]
    counts = spark.createDataFrame(rows, "pattern string, anaphor string, antecedent string, cnt long")
    seeds = spark.createDataFrame([("roof", "house"), ("door", "barn")], "anaphor string, antecedent string")
    flags = {(r.anaphor, r.antecedent): r.hit for r in patterns.flag_hits(counts.where("pattern like '%of%'"), seeds, "relaxed").collect()}
    assert flags == {("Roof", "House"): True, ("door", "house"): True, ("roof", "barn"): True, ("tap", "sink"): False}
    scored = {r.pattern: (r.hits, r.total, r.score) for r in patterns.score_patterns(patterns.flag_hits(counts, seeds, "relaxed")).collect()}
    assert scored["<X> of <Y>"] == (7, 8, pytest.approx(7 / 8 * math.log(7))) and scored["<X> in <Y>"] == (0, 5, 0.0)
    got = bootstrapping.bootstrap(counts, seeds, rounds=1, mode="relaxed", at_least=3)
    assert [p for p, _, _ in got.patterns] == ["<X> of <Y>"] and {(a, t) for a, t, _, _ in got.pairs} == {("Roof", "House"), ("door", "house"), ("roof", "barn"), ("tap", "sink")}
    assert bootstrapping.bootstrap(counts, seeds, rounds=1, mode="relaxed", at_least=5).pairs == []


def test_vector_match(spark):
    vectors = spark.createDataFrame([("roof", [1.0, 0.0]), ("roofs", [0.9, 0.1]), ("house", [0.0, 1.0]), ("home", [0.1, 0.9]), ("car", [-1.0, 0.0])], "word string, vector array<double>")
    lexicon = spark.createDataFrame([("roof", "house"), ("house", "roof")], "anaphor string, antecedent string")
    counts = spark.createDataFrame([("p", "roofs", "home", 1), ("p", "roofs", "roof", 1), ("p", "car", "home", 1), ("p", "unknown", "house", 1)], "pattern string, anaphor string, antecedent string, cnt long")
    by = lambda **kw: {(r.anaphor, r.antecedent): r.hit for r in patterns.vector_match(counts, lexicon, vectors, **kw).collect()}
    assert by() == {("roofs", "home"): True, ("roofs", "roof"): True, ("car", "home"): False, ("unknown", "house"): False}
    assert by(strict=True) == {("roofs", "home"): True, ("roofs", "roof"): False, ("car", "home"): False, ("unknown", "house"): False}
    assert not any(by(threshold=1.01).values())


def test_seeds_of_noun_phrases(spark):
    w = spark.createDataFrame(
        [("d", 0, 0, "Rain", "NN", "(TOP(S(NP*)", "(1)", "*"), ("d", 0, 1, "fell", "VBD", "(VP*)))", "(2)", "*")], "doc string, sent int, word_idx int, token string, pos string, parse_bit string, coref string, ner string"
    )
    m = trees.mentions(w)
    assert [r.ment for r in trees.noun_phrases(m, w).collect()] == ["0:0:0:1"]
    links = spark.createDataFrame(
        [("d", "0:0:0:1", "0:0:0:1", "Rain", "Rain", "the Rain", "Rain"), ("d", "0:1:1:2", "0:0:0:1", "fell", "Rain", "fell", "Rain"), ("d", "0:0:0:1", "0:0:0:1", None, "Rain", "x", "y")],
        "doc string, anaphor_ment string, antecedent_ment string, anaphor_head string, antecedent_head string, anaphor_text string, antecedent_text string",
    )
    pairs = lambda **kw: {tuple(r) for r in trees.seed_pairs(links, **kw).collect()}
    assert pairs() == {("Rain", "Rain"), ("fell", "Rain")} and pairs(phrases=trees.noun_phrases(m, w)) == {("Rain", "Rain")}
    assert pairs(heads=False) == {("the_Rain", "Rain"), ("fell", "Rain"), ("x", "y")} and pairs(heads=False, phrases=trees.noun_phrases(m, w)) == {("the_Rain", "Rain"), ("x", "y")}


def test_best_candidate(spark):
    rows = [("d", "a", "t1", 0.5, 1, 0), ("d", "a", "t2", 0.9, 2, 1), ("d", "a", "t3", 0.9, 1, 3), ("d", "a", "t4", 0.9, 1, 2), ("d", "b", "t1", 0.0, 0, 0), ("d", "b", "t2", -1.0, 0, 1), ("e", "a", "t9", 0.1, 5, 0)]
    scored = spark.createDataFrame(rows, "doc string, anaphor string, antecedent string, score double, distance int, ord int")
    assert {tuple(r) for r in mentions.best_candidate(scored).collect()} == {("d", "a", "t4"), ("e", "a", "t9")}


def test_containment(spark):
    rows = [("d", 0, "m1", 0, 4), ("d", 0, "m2", 1, 2), ("d", 0, "m3", 1, 2), ("d", 0, "m4", 5, 6), ("d", 1, "m5", 1, 2)]
    m = spark.createDataFrame(rows, "doc string, sent int, ment string, start int, end int")
    got = {r.ment: (r.has_child, r.is_child) for r in mentions.containment(m).collect()}
    assert got == {"m1": (True, False), "m2": (False, True), "m3": (False, True), "m4": (False, False), "m5": (False, False)}


def test_generalised_resource(spark):
    pairs = spark.createDataFrame([("roof", "house"), ("door", "house"), ("x", "house"), ("roof", "x")], "a_head string, t_head string")
    general = spark.createDataFrame([("roof", "top"), ("house", "building")], "word string, synset string")
    known = spark.createDataFrame([("top", "building"), ("null", "building"), ("top", "null")], "anaphor string, antecedent string")
    got = {(r.a_head, r.t_head): r.generalized_resource for r in mentions.generalized_resource(pairs, general, known).collect()}
    assert got == {("roof", "house"): True, ("door", "house"): False, ("x", "house"): False, ("roof", "x"): False}


def test_relations_and_similarity(spark):
    lemmas = spark.createDataFrame([("s1", "house"), ("s2", "roof"), ("s3", "roof")], "synset string, lemma string")
    edges = spark.createDataFrame([("s1", "part_meronym", "s2"), ("s3", "hypernym", "s1")], "synset string, rel string, target string")
    pairs = spark.createDataFrame([("roof", "house"), ("house", "roof"), ("roof", "car")], "a string, b string")
    by = lambda df, c: {(r.a, r.b): r[c] for r in df.collect()}
    assert by(resources.related(pairs, lemmas, edges, ["part_meronym"]), "related") == {("roof", "house"): True, ("house", "roof"): False, ("roof", "car"): False}
    assert by(resources.related(pairs, lemmas, edges, ["part_meronym"], of="a"), "related") == {("roof", "house"): False, ("house", "roof"): True, ("roof", "car"): False}
    paths = spark.createDataFrame([("roof", "s2", 0), ("roof", "top", 2), ("roof", "top", 1), ("house", "s1", 0), ("house", "top", 3)], "word string, synset string, depth int")
    got = by(resources.similarity(pairs, paths, 20), "similarity")
    assert got[("roof", "house")] == got[("house", "roof")] == pytest.approx(-math.log(5 / 40)) and got[("roof", "car")] is None


def test_scalars(spark):
    df = spark.createDataFrame([("NNS", "<Y> of <X>", "the roof of house fell", 0), ("VBZ", "<X> <Y>", "roof of", 3), ("PRP$", "x <Y>", "", 39)], "tag string, pattern string, text string, d int")
    x, y = C.slot_words(F.col("text"), "<Y> of <X>")
    got = df.select(C.coarse_pos(F.col("tag")), C.anaphor_slot_first(F.col("pattern")), C.swap_slots(F.col("pattern")), x, y, C.leacock_chodorow(F.col("d"), 20)).collect()
    assert [r[1] for r in got] == [True, False, False] and [r[2] for r in got] == ["<X> of <Y>", "<Y> <X>", "x <X>"]
    assert [(r[3], r[4]) for r in got] == [("house", "roof"), ("", ""), ("", "")]
    assert [r[5] for r in got] == [pytest.approx(-math.log((k + 1) / 40)) for k in (0, 3, 39)]
    heads = spark.createDataFrame([("NNP", "Rome"), ("NNS", "roofs"), ("PRP", "it"), ("DT", "everyone"), ("VB", "go")], "tag string, head string")
    got = heads.select(C.np_type(F.col("tag"), F.col("head")), C.np_number(F.col("tag"))).collect()
    assert [tuple(r) for r in got] == [("proper", "sing"), ("common", "plural"), ("pronoun", "other"), ("pronoun", "other"), ("other", "other")]


def test_recognition_alone(spark):
    p = spark.createDataFrame([("d", "m1", True, 1), ("d", "m2", False, 1), ("d", "m3", True, 0)], "doc string, ment string, predicted boolean, label int")
    assert sorted(tuple(r) for r in learning.self_pairs(p).collect()) == [("d", "m1", "m1"), ("d", "m3", "m3")]
    assert tuple(learning.accuracy(p).first()) == (3, 1, 0.5, 0.5)
