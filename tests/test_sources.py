"""Readers and writers against literal files."""

import glob
import json

from pyspark.sql import functions as F

from quillspark.operators import bootstrapping, patterns, trees
from quillspark.sources import readers, writers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def written(path):
    return [x for p in sorted(glob.glob(f"{path}/part-*")) for x in open(p).read().splitlines()]


def test_word_pairs(spark, tmp_path):
    p = put(tmp_path, "r.tsv", "old_roof\tthe_house\nroof\tbarn\nroof\thouse\nalone\n\tx\n")
    got = {r.anaphor: sorted(r.antecedents) for r in readers.word_pairs(spark, p).collect()}
    assert got == {"roof": ["barn", "house", "house"]}
    whole = {r.anaphor: sorted(r.antecedents) for r in readers.word_pairs(spark, p, heads=False).collect()}
    assert whole == {"old_roof": ["the_house"], "roof": ["barn", "house"]}


def test_words_and_vectors(spark, tmp_path):
    v = readers.vectors(spark, put(tmp_path, "v.txt", "roof 1 0.5\nalone\nhouse -2 0\n"))
    assert rows(v, "word") == [("house", [-2.0, 0.0]), ("roof", [1.0, 0.5])]
    p = put(tmp_path, "w.txt", "Side\nside\n\n top \n")
    assert rows(readers.word_list(spark, p), "word") == [("side",), ("top",)]
    assert rows(readers.word_list(spark, p, lower=False), "word") == [("Side",), ("side",), ("top",)]
    assert rows(readers.all_words(spark, put(tmp_path, "a.txt", "old_roof house\nroof\n\n")), "word") == [("house",), ("roof",), ("roof",)]
    assert rows(readers.patterns(spark, put(tmp_path, "p.txt", "<X> of <Y>\n\n<Y> <X> \n")), "pattern") == [("<X> of <Y>",), ("<Y> <X>",)]
    assert rows(readers.addresses(spark, put(tmp_path, "n.txt", "wsj_1  0 4\n\nwsj_2\n")), "fields") == [(["wsj_1", "0", "4"],), (["wsj_2"],)]


def test_json(spark, tmp_path):
    assert rows(readers.json_map(spark, put(tmp_path, "r.json", '{"side": 0.75, "top": 0}')), "key") == [("side", 0.75), ("top", 0.0)]
    p = put(tmp_path, "f.json", json.dumps({"d:1": {"head": "roof", "len": "2"}, "d:2": {"head": "house"}}))
    assert rows(readers.features(spark, p), "key", "name") == [("d:1", "head", "roof"), ("d:1", "len", "2"), ("d:2", "head", "house")]
    assert rows(readers.features(spark, p, without=["head"])) == [("d:1", "len", "2")]
    counts = put(tmp_path, "c.json", json.dumps({"<Y> of <X>": {"roof": {"house": 2, "barn": 1}}, "<X> has <Y>": {"car": {"engine": 5}}}))
    got = rows(readers.nested_counts(spark, counts), "pattern", "antecedent")
    assert got == [("<X> has <Y>", "engine", "car", 5), ("<Y> of <X>", "roof", "barn", 1), ("<Y> of <X>", "roof", "house", 2)]


def test_links_and_gold_pairs(spark, tmp_path):
    (tmp_path / "g").mkdir()
    put(tmp_path / "g", "d1.txt", "the roof\tm1\told house\tm2|m3\n\nno ids\n")
    got = rows(readers.links(spark, str(tmp_path / "g")), "anaphor_text")
    assert got == [("d1", "the roof", "m1", "old house", ["m2", "m3"])]
    assert rows(readers.gold_pairs(spark, put(tmp_path, "h.tsv", "the_roof\tm1\told_house\tm2\nx\tm1\n"))) == [("roof", "house")]


FRAMES = """<frameset><predicate lemma="gift">
<roleset id="gift.01" name="giving" source="verb-give.01" vncls="13.1 13.4.2"><roles><role n="0" descr="giver"/><role n="1" descr="thing"/></roles>
<example name="a"><text> her gift to us </text><arg n="0">her</arg><arg n="2">to us</arg><rel>gift</rel></example><example name="b"><text>gifts</text><rel>gifts</rel></example></roleset>
<roleset id="gift.02" vncls="-"><roles/></roleset></predicate></frameset>"""


def test_frames(spark, tmp_path):
    one, two = readers.frames(spark, put(tmp_path, "gift.xml", FRAMES)).orderBy("roleset").collect()
    assert (one.roleset, one.name, one.source, one.classes) == ("gift.01", "giving", "verb-give.01", ["13.1", "13.4.2"])
    assert [tuple(r) for r in one.roles] == [("0", "giver"), ("1", "thing")]
    assert [(e.name, e.text, e.rel, [tuple(a) for a in e.args]) for e in one.examples] == [("a", "her gift to us", "gift", [("0", "her"), ("2", "to us")]), ("b", "gifts", "gifts", [])]
    assert (two.name, two.source, two.classes, two.roles, two.examples) == (None, None, [], [], [])


LISTS = """(ADJADV :ORTH "able one"
  :ADV "ably" :FEATURES ((GRADABLE) (MANNER-ADV :TEMP (T (U "v")))))
(NOMADV :ORTH "abuse" :ADV ("abusively" "ab") :FEATURES ((EVAL-ADV)) :FEATURES ((GRADABLE)))
"""


def nested(df, entry):
    """Lists of lists from the rows of an entry."""
    own = df.where(F.col("entry") == entry).orderBy("pos").collect()
    top = min(r.list for r in own)

    def build(at):
        return [build(r.pos) if r.item == "(" else r.item for r in own if r.list == at]

    return build(top)


def test_dictionaries(spark, tmp_path):
    assert rows(readers.morphology(spark, put(tmp_path, "m.txt", "roof roofs rooves\nalone\n")), "variant") == [("roof", "roofs"), ("roof", "rooves")]
    p = put(tmp_path, "adv.txt", LISTS)
    got = rows(readers.adverb_entries(spark, p).where("orth = 'abuse'"))
    assert got == [("NOMADV", "abuse", ["abusively", "ab"], ["((EVAL-ADV))", "((GRADABLE))"])]
    s = readers.sexpressions(spark, p)
    assert nested(s, 1) == ["ADJADV", ":ORTH", "able one", ":ADV", "ably", ":FEATURES", [["GRADABLE"], ["MANNER-ADV", ":TEMP", ["T", ["U", "v"]]]]]
    assert nested(s, 2) == ["NOMADV", ":ORTH", "abuse", ":ADV", ["abusively", "ab"], ":FEATURES", [["EVAL-ADV"]], ":FEATURES", [["GRADABLE"]]]
    assert s.agg(F.max("depth")).first()[0] == 5
    assert readers.sexpressions(spark, put(tmp_path, "none.txt", "stray ) words\n")).count() == 0


DATA = """  1 a licence line
00000010 06 n 02 House 0 home 1 002 @ 00000030 n 0000 %p 00000020 n 0000 | a place | to live
00000020 06 n 01 roof 0 003 @ 00000030 n 0000 #p 00000010 n 0000 >> 00000040 s 0101 | on top
00000030 03 n 0a a 0 b 0 c 0 d 0 e 0 f 0 g 0 h 0 i 0 j 0 000 | ten words
00000040 00 s 01 flat 0 000 | even
"""


def test_lexical_net(spark, tmp_path):
    lemmas, edges = readers.lexical_net(spark, put(tmp_path, "data.noun", DATA))
    assert rows(lemmas.where("synset <> 'n00000030'"), "synset", "lemma") == [("a00000040", "flat"), ("n00000010", "home"), ("n00000010", "house"), ("n00000020", "roof")]
    assert lemmas.where("synset = 'n00000030'").count() == 10
    assert rows(edges, "synset", "rel") == [
        ("n00000010", "hypernym", "n00000030"), ("n00000010", "part_meronym", "n00000020"), ("n00000020", ">>", "a00000040"), ("n00000020", "hypernym", "n00000030"), ("n00000020", "part_holonym", "n00000010"),
    ]
    s = readers.senses(spark, put(tmp_path, "index.noun", "  1 licence\nhouse n 2 3 @ ~ %p 2 1 00000010 00000030\nroof n 1 0 1 0 00000020\n"))
    assert rows(s, "lemma", "rank") == [("house", 1, "n00000010"), ("house", 2, "n00000030"), ("roof", 1, "n00000020")]


def test_link_writers(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("the roof", "m1", "the old house", ["m2", "m3"], "roof", ["house", "it"])], "anaphor_text string, anaphor string, antecedent_text string, chain_ids array<string>, anaphor_head string, chain_heads array<string>"
    )
    assert rows(writers.gold_lines(pairs)) == [("the roof\tm1\tthe old house\tm2|m3",)]
    assert rows(writers.gold_lines(pairs, heads=True)) == [("roof\tm1\thouse;it\tm2|m3",)]
    path = str(tmp_path / "gold")
    writers.gold_lines(pairs).write.text(path)
    assert [r[1:] for r in rows(readers.links(spark, path))] == [("the roof", "m1", "the old house", ["m2", "m3"])]
    system = spark.createDataFrame([("a", "m1", "b", "m2"), ("c", None, "d", "m4"), ("e", "m5", "f", None)], "anaphor_text string, anaphor string, antecedent_text string, antecedent string")
    assert rows(writers.system_lines(system)) == [("a\tm1\tb\tm2",)]


def test_other_writers(spark, tmp_path):
    out = lambda n: str(tmp_path / n)
    writers.bootstrapped(bootstrapping.Bootstrapped([("<X> of <Y>", 1.5, 1), ("<Y> <X>", 0.5, 2)], [("roof", "house", 1.1, 1), ("door", "house", 1.1, 1), ("tap", "sink", 1.0, 2)]), spark, out("b"))
    assert written(out("b/patterns")) == ["<X> of <Y>", "<Y> <X>"] and written(out("b/wordpairs")) == ["door\thouse", "roof\thouse", "tap\tsink"]
    assert written(out("b/anaphors")) == ["door", "roof", "tap"] and written(out("b/antecedents")) == ["house", "sink"]
    writers.bootstrapped(bootstrapping.Bootstrapped([], []), spark, out("e"))
    assert written(out("e/wordpairs")) == []
    pairs = spark.createDataFrame([("roof", "house"), ("tap", None)], "anaphor string, antecedent string")
    mapping = spark.createDataFrame([("roof", "top"), ("house", "building")], "word string, synset string")
    writers.generalised(pairs, mapping, out("g"))
    assert sorted(written(out("g"))) == ["null\tnull", "top\tbuilding"]
    writers.word_dump(pairs.where("antecedent is not null"), out("w"))
    assert written(out("w")) == ["roof", "house"]
    writers.features(pairs, out("f"))
    assert sorted(map(str, map(json.loads, written(out("f"))))) == ["{'anaphor': 'roof', 'antecedent': 'house'}", "{'anaphor': 'tap'}"]
    assert sorted(rows(writers.cache(pairs, out("c")), "anaphor")) == [("roof", "house"), ("tap", None)]
    assert writers.cache(pairs.limit(0), out("c")).count() == 0


def test_offsets_and_attached_tokens(spark, tmp_path):
    p = put(tmp_path, "a.conll", "#begin document (x); part 000\nf 0 0 Rain NN (TOP(S(NP*) - - - - * (1)\nf 0 1 fell VBD (VP*))) - - - - * -\n\n#end document\n")
    words = readers.conll(spark, p)
    assert [r[1:2] + r[3:] for r in rows(readers.offsets(words), "offset")] == [(1, 0, 0), (2, 0, 1)]
    keyed = trees.keyed(words)
    m = trees.mentions(keyed)
    got = trees.attach_tokens(m, keyed.select("doc", "sent", "word_idx", F.lit("nsubj").alias("dep")))
    assert rows(got.select("head", "dep")) == [("Rain", "nsubj")]
    assert rows(trees.attach_tokens(m, keyed.select("doc", "sent", "word_idx", F.lit("x").alias("dep")).limit(0)).select("dep")) == [(None,)]
