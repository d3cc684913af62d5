import pytest

from quillspark.functions import columns as C
from quillspark.operators import bootstrapping, evaluation, mentions, patterns, resources
from quillspark.sources import readers, writers


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_tagged_sentence_gives_both_directions(spark, tmp_path):
    path = write(tmp_path, "a.txt", "the_DT roof_NN of_IN the_DT house_NN collapsed_VBD near_IN town_NN ._.\n")
    s = readers.tagged(spark, path)
    got = {tuple(r) for r in patterns.extract(s).collect()}
    assert got == {("<Y> of the <X>", "roof", "house"), ("<X> of the <Y>", "house", "roof"), ("<Y> collapsed near <X>", "house", "town"), ("<X> collapsed near <Y>", "town", "house")}
    assert {r.pattern for r in patterns.candidates_v1(s).collect()} == {p for p, _, _ in got}
    short = readers.tagged(spark, write(tmp_path, "b.txt", "the_DT roof_NN of_IN the_DT house_NN collapsed_VBD near_IN town_NN\n"))
    assert patterns.extract(short).count() == 2
    assert [tuple(r) for r in patterns.match_pattern(s, "<Y> of the <X>").select("anaphor", "antecedent").collect()] == [("roof", "house")]
    assert patterns.match_pattern(s, "<Y> <X>").count() == 0


def test_run_of_nouns_gives_bare_patterns(spark, tmp_path):
    s = readers.tagged(spark, write(tmp_path, "a.txt", "car_NN has_VBZ engine_NN oil_NN ._.\n"))
    assert sorted(r.pattern for r in patterns.candidates_v1(s).collect()) == ["<X> <Y>", "<X> has <Y>", "<Y> <X>", "<Y> has <X>"]
    assert [tuple(r) for r in patterns.compounds(s).collect()] == [("oil", "engine")]


def test_scores(spark):
    rows = [("p", "a", str(k), 1, k < 7) for k in range(13)] + [("q", "a", "b", 1, True), ("r", "a", "b", 1, False)]
    got = {r.pattern: r.score for r in patterns.score_patterns(spark.createDataFrame(rows, "pattern string, anaphor string, antecedent string, cnt long, hit boolean")).collect()}
    assert got == {"p": pytest.approx(1.0477977725682455, abs=0), "q": 0.0, "r": 0.0}
    c = spark.createDataFrame([("p", "x", "y", 3), ("q", "x", "y", 1)], "pattern string, anaphor string, antecedent string, cnt long")
    sel = spark.createDataFrame([("p", 1.0), ("q", 0.5)], "pattern string, score double")
    assert patterns.score_pairs(c, sel).first().score == pytest.approx(2.015)


def test_bootstrap_adds_pairs_of_the_best_pattern(spark):
    rows = [("p", "a", "b", 3), ("p", "c", "d", 2), ("q", "e", "f", 9)]
    c = spark.createDataFrame(rows, "pattern string, anaphor string, antecedent string, cnt long")
    seeds = spark.createDataFrame([("x_a", "y_b")], "anaphor string, antecedent string")
    got = bootstrapping.bootstrap(c, seeds, rounds=2, per_round=5)
    assert [p for p, _, _ in got.patterns] == ["p"] and [(a, t) for a, t, _, _ in got.pairs] == [("c", "d")]


def test_backward_search_stops_before_sentence_zero(spark):
    m = spark.createDataFrame([("d", f"m{s}", s, 0, 0, ["house"], "house", 0) for s in range(3)] + [("d", "a", 3, 0, 0, ["roof"], "roof", 0)], "doc string, ment string, sent int, start int, end int, tokens array<string>, head string, ord int")
    lex = spark.createDataFrame([("roof", "house")], "anaphor string, antecedent string")
    assert [r.antecedent for r in mentions.backward_search(m, lex).collect()] == ["m2"]
    assert mentions.backward_search(m.where("sent in (0, 3)"), lex).count() == 0
    assert {r.antecedent for r in mentions.candidate_window(m, 1).where("anaphor = 'a'").collect()} == {"m2"}


def test_reversed_append_order(spark):
    from pyspark.sql import functions as F

    def order(n):
        df = spark.range(1, n + 1).select(F.col("id").cast("int").alias("k"))
        return [r.k for r in df.orderBy(mentions.reversed_append_order(F.col("k"), F.lit(n))).collect()]

    assert order(4) == [4, 2, 1, 3] and order(5) == [5, 3, 1, 2, 4]


def test_link_scores(spark):
    schema = "doc string, anaphor string, antecedents array<string>"
    gold = spark.createDataFrame([("f", "a1", ["x", "y"]), ("f", "a2", ["z"])], schema)
    system = spark.createDataFrame([("f", "a1", ["y"]), ("f", "a1", ["q"]), ("f", "a3", ["z"])], schema)
    r = evaluation.score_links(gold, system).first()
    assert (r.correct, r.link_precision, r.link_recall, r.link_f1) == (1, pytest.approx(1 / 3), 0.5, pytest.approx(0.4))
    assert (r.n_system_anaphors, r.anaphor_precision, r.anaphor_recall, r.anaphor_f1) == (2, 0.5, 0.5, 0.5)
    empty = evaluation.score_links(gold.limit(0), system.limit(0)).first()
    assert empty.link_f1 == 0 and empty.anaphor_precision == 0


def test_tf_idf_and_coverage(spark):
    t = spark.createDataFrame([("f1", "a"), ("f1", "a"), ("f1", "b"), ("f2", "b")], "doc_id string, token string")
    got = {(r.doc_id, r.token): r.score for r in resources.tf_idf(resources.term_counts(t)).collect()}
    assert got["f1", "a"] == pytest.approx(0.46209812037329684) and got["f1", "b"] == 0 and got["f2", "b"] == 0
    gold = spark.createDataFrame([("roof", "house"), ("door", "house"), ("door", "car")], "anaphor string, antecedent string")
    r = resources.coverage(gold, gold.where("antecedent = 'house'")).first()
    assert (r.anaphor_coverage, r.antecedent_coverage, r.pair_coverage) == (1.0, 0.5, pytest.approx(2 / 3))


def test_heads_and_features(spark):
    rows = [(["the", "old", "oil", "price", "of", "gas"], ["DT", "JJ", "NN", "NN", "IN", "NN"]), (["very", "late"], ["RB", "JJ"])]
    df = spark.createDataFrame(rows, "tokens array<string>, tags array<string>")
    from pyspark.sql import functions as F

    got = df.select(C.pos_head(F.col("tokens"), F.col("tags")).alias("h"), C.has_preposition(F.col("tags")).alias("p"), C.determiner_first(F.col("tokens")).alias("d"), C.content_words(F.col("tokens"), F.col("tags")).alias("c"), C.length_bin(F.size("tokens")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("price", True, "def", ["old", "oil", "price", "gas"], 4), ("late", False, "no_det", ["late"], 2)]
    a = spark.createDataFrame([(["North", "Atlantic", "of", "Treaty"],)], "t array<string>").select(C.acronym(F.col("t")).alias("a")).first().a
    assert a == "NAT"


CONLL = """#begin document (x); part 000
f 0 0 The DT (TOP(S(NP* - - - - * - (1
f 0 1 roof NN *) - - - - * - 1)
f 0 2 fell VBD (VP*))) - - - - * (V*) -

#end document
#begin document (x); part 001
f 0 0 It PRP (TOP(S(NP*) - - - - * (1)
f 0 1 broke VBD (VP*))) - - - - * -

#end document
"""


def test_conll_reader(spark, tmp_path):
    w = readers.conll(spark, write(tmp_path, "a.conll", CONLL)).orderBy("offset").collect()
    assert [(r.doc, r.sent, r.word_idx, r.token, r.offset) for r in w] == [(0, 0, 0, "The", 1), (0, 0, 1, "roof", 2), (0, 0, 2, "fell", 3), (1, 0, 0, "It", 4), (1, 0, 1, "broke", 5)]
    assert w[0].coref == "(1" and w[2].pred_args == ["(V*)"]


def test_markables_and_propositions(spark, tmp_path):
    xml = '<markables><markable id="m1" span="word_3..word_5" information_status="mediated" mediated_type="bridging" bridge_type="x" bridged_from="m0"/><markable id="m0" span="word_1" information_status="old"/></markables>'
    got = {r.id: r for r in readers.markables(spark, write(tmp_path, "m.xml", xml)).collect()}
    assert (got["m1"].span_start, got["m1"].span_end, got["m1"].antecedents) == (3, 5, ["m0"]) and (got["m0"].span_start, got["m0"].span_end, got["m0"].antecedents) == (1, 1, [])
    line = "wsj/00/x.mrg 3 5 gift 01 2:0*4:0-ARG0 5:0-rel 6:0,7:1-ARG1-REF\n"
    p = readers.propositions(spark, write(tmp_path, "p.txt", line)).first().pieces
    assert [x.label for x in p] == ["ARG0", "rel", "ARG1"] and p[2].tags == ["REF"]
    assert [[tuple(y) for y in c] for c in p[0].chain] == [[(2, 0)], [(4, 0)]] and [tuple(y) for y in p[2].chain[0]] == [(6, 0), (7, 1)]


def test_lists_and_lines(spark, tmp_path):
    d = readers.demonyms(spark, write(tmp_path, "d.tsv", "A\tAish\nB\nA\tAnian\n")).collect()
    assert [tuple(r) for r in d] == [("A", "Anian")]
    s = spark.createDataFrame([("a b c_NN ü",)], "value string")
    assert readers.normalised_tagged(s).first().value == "a_XX b_XX c_NN"
    out = str(tmp_path / "out")
    writers.seeds(spark.createDataFrame([("a", "b")], "anaphor string, antecedent string"), out)
    assert [tuple(r) for r in readers.seeds(spark, out).collect()] == [("a", "b")]
    j = spark.createDataFrame([('{"<X> of <Y>": {"w": {"v": 3}}}',)], "json string")
    assert [tuple(r) for r in patterns.from_json(j).collect()] == [("<X> of <Y>", "v", "w", 3)]
