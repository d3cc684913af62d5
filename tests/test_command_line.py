import glob

from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.operators import mentions, resolver
from quillspark.sources import readers

TEXT = "#begin document (x); part 000\nf 0 0 Rain NN (TOP(S(NP*) - - - - * (1)\nf 0 1 fell VBD (VP*))) - - - - * -\n\nf 0 0 Rain NN (TOP(S(NP*) - - - - * (2)\nf 0 1 fell VBD (VP*))) - - - - * -\n\n#end document\n"

NET = """00000010 03 n 01 house 0 002 @ 00000030 n 0000 %p 00000020 n 0000 | a building
00000020 03 n 01 roof 0 002 @ 00000030 n 0000 #p 00000010 n 0000 | a cover
00000030 03 n 01 thing 0 000 | a thing
"""


def test_score_and_coverage(spark, tmp_path, capsys):
    (tmp_path / "gold").mkdir()
    (tmp_path / "system").mkdir()
    (tmp_path / "gold" / "f.txt").write_text("a\ta1\tt\tx|y\nb\ta2\tt\tz\n")
    (tmp_path / "system" / "f.txt").write_text("a\ta1\tt\ty\na\ta1\tt\tq\na\ta3\tt\tz\n")
    main(["score", str(tmp_path / "gold"), str(tmp_path / "system")])
    assert capsys.readouterr().out.splitlines() == ["link P 0.3333 R 0.5000 F 0.4000", "anaphor P 0.5000 R 0.5000 F 0.5000"]
    (tmp_path / "g.tsv").write_text("old_roof\tm1\tthe_house\tm2\ndoor\tm3\thouse\tm2|m9\ndoor\tm3\ta_car\tm4\n")
    (tmp_path / "r.tsv").write_text("a_roof\thouse\ndoor\tbig_house\n")
    main(["coverage", str(tmp_path / "g.tsv"), str(tmp_path / "r.tsv")])
    assert capsys.readouterr().out.splitlines() == ["anaphor 2/2 1.0000", "antecedent 1/2 0.5000", "pair 2/3 0.6667"]


def test_coref_writes_clusters(spark, tmp_path):
    (tmp_path / "a.conll").write_text(TEXT)
    main(["coref", str(tmp_path / "a.conll"), str(tmp_path / "out")])
    lines = [x for p in sorted(glob.glob(str(tmp_path / "out" / "part-*"))) for x in open(p).read().splitlines()]
    assert [x.split("\t")[-1] for x in lines] == ["#begin document (x); part 000", "(1)", "-", "", "(1)", "-", "", "#end document"]


def story(k):
    # candidates are looked for from the second sentence on
    rows = [("It", "PRP", "(TOP(S(NP*)", "-"), ("rained", "VBD", "(VP*)))", "-"), None, ("The", "DT", "(TOP(S(NP*", "(1"), ("house", "NN", "*)", "1)"), ("stood", "VBD", "(VP*)))", "-"), None, ("The", "DT", "(TOP(S(NP*", "(2"), ("roof", "NN", "*)", "2)"), ("hit", "VBD", "(VP*", "-"), ("a", "DT", "(NP*", "(3"), ("car", "NN", "*))))", "3)")]
    lines, at = [f"#begin document (x{k}); part 000"], 0
    for r in rows:
        lines.append("" if r is None else f"f 0 {at} {r[0]} {r[1]} {r[2]} - - - - * {r[3]}")
        at = 0 if r is None else at + 1
    return "\n".join([*lines, "", "#end document", ""])


def test_resolve_finds_the_links_of_other_folds(spark, tmp_path):
    for name in ("text", "marks"):
        (tmp_path / name).mkdir()
    xml = '<markables><markable id="m1" span="word_3..word_4" information_status="new"/><markable id="m2" span="word_6..word_7" information_status="mediated" mediated_type="bridging" bridge_type="x" bridged_from="m1"/></markables>'
    for k in range(8):
        (tmp_path / "text" / f"d{k}.conll").write_text(story(k))
        (tmp_path / "marks" / f"d{k}.xml").write_text(xml)
    (tmp_path / "r.tsv").write_text("roof\thouse\n")
    main(["resolve", str(tmp_path / "text"), str(tmp_path / "marks"), str(tmp_path / "r.tsv"), str(tmp_path / "out"), "--folds", "2"])
    lines = [x for p in glob.glob(str(tmp_path / "out" / "part-*")) for x in open(p).read().splitlines()]
    assert lines == ["The roof\tm2\tThe house\tm1"] * 8
    # all tables of features; the lexicon knows nothing, the net and the pair of synsets do
    (tmp_path / "none.tsv").write_text("sun\tmoon\n")
    (tmp_path / "general.tsv").write_text("roof\tn1\nhouse\tn2\n")
    (tmp_path / "pairs.tsv").write_text("n1\tn2\n")
    (tmp_path / "data.noun").write_text(NET)
    main(["resolve", str(tmp_path / "text"), str(tmp_path / "marks"), str(tmp_path / "none.tsv"), str(tmp_path / "out2"), "--folds", "2", "--general", str(tmp_path / "general.tsv"), "--general-pairs", str(tmp_path / "pairs.tsv"), "--net", str(tmp_path / "data.noun")])
    lines = [x for p in glob.glob(str(tmp_path / "out2" / "part-*")) for x in open(p).read().splitlines()]
    assert lines == ["The roof\tm2\tThe house\tm1"] * 8


def test_features_by_the_net(spark, tmp_path):
    (tmp_path / "data.noun").write_text(NET)
    lemmas, edges = readers.lexical_net(spark, str(tmp_path / "data.noun"))
    m = spark.createDataFrame([(1, "a", 0, 0, 0, ["roof"], "roof", 1), (1, "b", 0, 2, 2, ["house"], "house", 2), (1, "c", 0, 4, 4, ["zzz"], None, 3)], "doc int, ment string, sent int, start int, end int, tokens array<string>, head string, ord int")
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "a", "c")], "doc int, anaphor string, antecedent string")
    lexicon = spark.createDataFrame([("x", "y")], "anaphor string, antecedent string")
    words = m.select("doc", F.explode("tokens").alias("token")).unionByName(spark.createDataFrame([(2, "roof"), (2, "7")], "doc int, token string"))
    top = resolver.corpus_terms(words, 1)
    assert {(r.doc, r.token) for r in top.collect()} == {(1, "house"), (2, "roof")}
    got = {r.antecedent: r for r in mentions.pair_features(pairs, m, lexicon, top, net=resolver.net_of_heads(m, lemmas, edges)).collect()}
    # a pair without a head stays
    assert set(got) == {"b", "c"}
    assert got["b"].meronym is True and got["b"].wn_dist is not None and got["b"].tfidf_ante is True
    assert got["c"].meronym is False and got["c"].tfidf_ante is False
