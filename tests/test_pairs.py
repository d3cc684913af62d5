"""Labels and bins against literal rows, and the features of pairs that need a net or a generalisation."""

from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators import mentions


def test_labels(spark):
    rows = [(None, None), (0.49, "nsubj"), (0.5, "dobj"), (1.0, "pobj"), (1.5, "nsubjpass"), (2.0, "oprd"), (2.5, "prd"), (3.0, "amod")]
    got = spark.createDataFrame(rows, "x double, dep string").select(C.similarity_bin(F.col("x")).alias("s"), C.grammatical_role(F.col("dep")).alias("r")).collect()
    assert [r.s for r in got] == ["low", "low", "lowish", "mid", "highish", "high", "higher", "really_high"]
    assert [r.r for r in got] == ["na", "nsubj", "dobj", "pobj", "nsubjpass", "pred", "pred", "other"]


def test_words_as_written(spark):
    rows = [("no", [], ["Some"]), ("each", [], ["some", "men"]), ("No", [], ["one", "man"]), ("sixty", [], ["a"]), ("men", ["each"], ["any"]), ("men", ["John", "'s"], ["x"]), ("men", ["John's"], ["x"]), ("men", ["neither"], ["x"])]
    df = spark.createDataFrame(rows, "head string, pre array<string>, tokens array<string>")
    got = df.select(C.is_set_element(F.col("head"), F.col("pre")), C.determiner_first(F.col("tokens")), C.determiner_class(F.col("pre"))).collect()
    assert [r[0] for r in got] == [True, True, False, True, True, False, False, False]
    assert [r[1] for r in got] == ["no_det", "indef", "def", "indef", "no_det", "no_det", "no_det", "no_det"]
    assert [r[2] for r in got] == ["no_det", "no_det", "no_det", "no_det", "indef", "poss", "no_det", "indef"]


def test_pair_features(spark):
    m = spark.createDataFrame(
        [("d", "1", ["the", "house"], ["DT", "NN"], "house", "NN", "*"), ("d", "2", ["two", "doors", "in", "front"], ["CD", "NNS", "IN", "NN"], "doors", "NNS", None), ("d", "3", ["house", "door"], ["NN", "NN"], "door", "NN", "ORG")],
        "doc string, ment string, tokens array<string>, tags array<string>, head string, head_tag string, ner string",
    )
    pairs = spark.createDataFrame([("d", "2", "1"), ("d", "3", "1"), ("d", "2", "3"), ("d", "3", "2")], "doc string, anaphor string, antecedent string")
    lexicon = spark.createDataFrame([("door", "house")], "anaphor string, antecedent string")
    general = spark.createDataFrame([("door", "opening"), ("doors", "opening"), ("house", "building")], "word string, synset string")
    known = spark.createDataFrame([("opening", "building"), ("null", "building")], "anaphor string, antecedent string")
    lemmas = spark.createDataFrame([("s.house", "house"), ("s.door", "door")], "synset string, lemma string")
    edges = spark.createDataFrame([("s.house", "part_meronym", "s.door")], "synset string, rel string, target string")
    paths = spark.createDataFrame([("house", "s.house", 0), ("house", "thing", 1), ("door", "s.door", 0), ("door", "thing", 1)], "word string, synset string, depth int")
    rows = mentions.pair_features(pairs, m, lexicon, general=general, general_pairs=known, net=(lemmas, edges, paths)).collect()
    got = {(r.anaphor, r.antecedent): r for r in rows}
    assert len(rows) == 4
    assert {k: r.pair_in_resource for k, r in got.items()} == {("2", "1"): False, ("3", "1"): True, ("2", "3"): False, ("3", "2"): False}
    assert {k: r.generalized_resource for k, r in got.items()} == {("2", "1"): True, ("3", "1"): True, ("2", "3"): False, ("3", "2"): False}
    assert {k: r.meronym for k, r in got.items()} == {("2", "1"): False, ("3", "1"): True, ("2", "3"): False, ("3", "2"): False}
    # -ln(3 / 40) is 2.59; words without a sense have no similarity
    assert {k: r.wn_dist for k, r in got.items()} == {("2", "1"): "low", ("3", "1"): "higher", ("2", "3"): "low", ("3", "2"): "low"}
    assert got["2", "1"].anaphor_pp and not got["3", "1"].anaphor_pp
    assert got["3", "1"].ante_head_in_anaphor and not got["2", "1"].ante_head_in_anaphor
    assert not any(r.number_plural for r in rows) and got["3", "1"].ante_ne_anap_head == "*-door" and got["2", "3"].ante_ne_anap_head == "ORG-doors"


def test_generalised_pairs_of_words_with_several_synsets(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None), ("a", "x")], "a_head string, t_head string")
    general = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three"), ("x", "up"), ("x", "down"), ("c", "one")], "word string, synset string")
    known = spark.createDataFrame([("one", "up"), ("two", "down"), ("one", "up"), ("three", "none"), (None, "up")], "anaphor string, antecedent string")
    rows = mentions.generalized_resource(pairs, general, known).collect()
    # one row for each pair, repeated ones too; a word without synset is in no pair
    assert sorted((r.a_head or "", r.t_head or "", r.generalized_resource) for r in rows) == [("", "x", False), ("a", "", False), ("a", "x", True), ("a", "x", True), ("a", "y", False), ("b", "x", False)]
    assert not any(r.generalized_resource for r in mentions.generalized_resource(pairs, general, known.limit(0)).collect())


def test_pairs_are_not_sent_for_the_features_of_one_side(spark):
    """Pairs made within the window carry what one mention gives: after the window's own join no join by mention follows. Before, each side was joined to all pairs."""
    m = spark.createDataFrame([(1, str(k), k // 2, k % 2 * 3, k % 2 * 3 + 1, k % 2, ["the", w], w) for k, w in enumerate(["house", "door", "roof", "door"])], "doc long, ment string, sent int, start int, end int, ord int, tokens array<string>, head string")
    lexicon = spark.createDataFrame([("door", "house")], "anaphor string, antecedent string")
    carried = mentions.pair_features(lambda s: mentions.candidate_window(s, 1, carry="side"), m, lexicon)
    apart = mentions.pair_features(mentions.candidate_window(m, 1), m, lexicon)
    assert carried._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    names = apart.columns
    assert sorted(map(str, carried.select(*names).collect())) == sorted(map(str, apart.collect())) and carried.where("pair_in_resource").count() == 2
