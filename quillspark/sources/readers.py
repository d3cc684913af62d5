"""Readers: text, tables, XML and JSON into typed tables. All parse in the JVM; files are found and split by Spark.

Large files are split wherever Spark splits them, also those whose rows depend on rows before (see ``spans``). A whole file
is one row only for lists and dictionaries: s-expressions, demonyms and JSON objects of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.sources import spans


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) trimmed of undecodable characters, one row for each line."""
    return spark.read.text(path).select(F.regexp_replace("value", "�", "").alias("value"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) with line numbers from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "�", ""), "\r?\n")).alias("line_no", "line"))


def conll(spark: SparkSession, path: str) -> DataFrame:
    """Words of CoNLL-2012 files: file, doc, header, sent, word_idx, token, pos, parse_bit, pred_lemma, frame_id,
    word_sense, speaker, ner, pred_args, coref, offset (from 1, running over a file) and sentence numbers from 0.

    ``#begin`` opens a document, ``#end`` closes it, blank lines end sentences; empty sentences and a last sentence
    without a blank line before ``#end`` are not kept apart from the rest: the first vanish, the second ends there. What stands outside
    of documents is left out. Files are cut after documents, and a document is one row until its words are dealt out."""
    cut = spans.pieces(spark, path, "\n#end").withColumn("value", F.regexp_replace("value", "\ufffd", ""))
    lines = lambda text: F.split(text, "\r?\n")
    docs = F.filter(F.split("value", r"(?m)^(?=#begin)"), lambda d: F.startswith(d, F.lit("#begin")))
    # sentences are what stands between lines that are blank or begin with a hash
    sents = lambda d: F.filter(F.split(F.regexp_replace(d, r"(?m)^(#[^\n]*|[^\S\n]*)$", "\u0000"), "\u0000"), lambda s: F.trim(F.regexp_replace(s, r"\s", "")) != "")
    words = lambda d: F.flatten(F.transform(sents(d), lambda s, k: F.transform(F.filter(lines(s), lambda x: F.trim(x) != ""), lambda x: F.struct(k.alias("sent"), F.trim(x).alias("line")))))
    made = F.transform(docs, lambda d: F.struct(F.regexp_extract(d, r"^([^\r\n]*)", 1).alias("header"), words(d).alias("words")))
    rows = cut.select("file", "block", "row", made.alias("docs")).select(F.inline(F.array(F.struct("file", "block", "row", "docs"))))
    rows = rows.withColumns({"n_docs": F.size("docs"), "n_words": F.size(F.flatten("docs.words"))})
    rows = spans.carried(rows, sums=["n_docs", "n_words"])
    each = rows.select("file", "n_docs_before", "n_words_before", "docs", F.posexplode("docs").alias("k", "d"))
    skipped = F.size(F.flatten(F.transform(F.slice("docs", F.lit(1), F.col("k")), lambda d: d["words"])))
    each = each.select("file", (F.col("n_docs_before") + F.col("k")).alias("doc"), F.col("d.header").alias("header"), (F.col("n_words_before") + skipped).alias("first"), F.posexplode("d.words").alias("i", "w"))
    f = F.split("w.line", r"(?U)\s+")
    n = F.size(f)
    return each.select(
        "file", "doc", "header", F.col("w.sent").alias("sent"), (F.col("first") + F.col("i") + 1).cast("int").alias("offset"),
        f[2].cast("int").alias("word_idx"), *(f[k].alias(c) for k, c in ((3, "token"), (4, "pos"), (5, "parse_bit"), (6, "pred_lemma"), (7, "frame_id"), (8, "word_sense"), (9, "speaker"), (10, "ner"))),
        F.slice(f, F.lit(12), F.greatest(n - 12, F.lit(0))).alias("pred_args"), F.element_at(f, -1).alias("coref"),
    )


def offsets(words: DataFrame) -> DataFrame:
    """file, offset, doc, sent, word_idx: where each running word number stands."""
    return words.select("file", "offset", "doc", "sent", "word_idx")


def markables(spark: SparkSession, path: str) -> DataFrame:
    """Markables of stand-off XML: file, id, span_start, span_end (word numbers), is_status, mediated_type, bridge_type
    and antecedents, an array of up to three ids. Bridge attributes are read only if mediated_type is ``bridging``."""
    names = ("id", "span", "information_status", "mediated_type", "bridge_type", "bridged_from", "second_bridged_from", "third_bridged_from")
    schema = ", ".join(f"_{n} string" for n in names)
    rows = spark.read.option("rowTag", "markable").schema(schema).xml(path).withColumn("file", F.input_file_name())
    one = F.regexp_extract("_span", r"^word_(\d+)", 1).cast("int")
    two = F.regexp_extract("_span", r"\.\.word_(\d+)$", 1)
    bridge = F.col("_mediated_type") == "bridging"
    second = F.when(F.col("_second_bridged_from").isNotNull(), F.col("_third_bridged_from"))
    chain = F.array_compact(F.array("_bridged_from", "_second_bridged_from", second))
    return rows.select(
        "file", F.col("_id").alias("id"), one.alias("span_start"), F.when(two == "", one).otherwise(F.try_to_number(two, F.lit("999999999")).cast("int")).alias("span_end"), F.col("_information_status").alias("is_status"),
        F.col("_mediated_type").alias("mediated_type"), F.when(bridge, F.col("_bridge_type")).alias("bridge_type"), F.when(bridge, chain).otherwise(F.array().cast("array<string>")).alias("antecedents"),
    )


def _split_tag(tok: Column) -> Column:
    at = F.length(tok) - F.length(F.substring_index(tok, "_", -1))
    return F.struct(F.when(at > 1, F.substring(tok, F.lit(1), at - 1)).otherwise(tok).alias("token"), F.when(at > 1, F.substring_index(tok, "_", -1)).otherwise("_").alias("tag"))


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of ``token_TAG`` text, one for each line: file, tokens, tags, nouns (flags for tags that begin with N).
    A token without tag gets ``_``."""
    toks = F.filter(F.split(F.trim("value"), r"(?U)\s+"), lambda t: t != "")
    pairs = _lines(spark, path).select(F.input_file_name().alias("file"), F.transform(toks, _split_tag).alias("p")).where(F.size("p") > 0)
    return pairs.select("file", F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["tag"]).alias("tags"), F.transform("p", lambda x: F.startswith(x["tag"], F.lit("N"))).alias("nouns"))


def normalised_tagged(df: DataFrame, column: str = "value") -> DataFrame:
    """Tagged lines without characters beyond ASCII, and with the tag XX where a token has none."""
    toks = F.filter(F.split(F.trim(F.regexp_replace(column, r"[^\x00-\x7F]", "")), r"\s+"), lambda t: t != "")
    return df.select(F.array_join(F.transform(toks, lambda t: F.when(F.contains(t, F.lit("_")), t).otherwise(F.concat(t, F.lit("_XX")))), " ").alias("value"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """anaphor, antecedent from a tab-separated list."""
    rows = spark.read.schema("anaphor string, antecedent string").csv(path, sep="\t", quote="")
    return rows.select(F.trim("anaphor").alias("anaphor"), F.trim("antecedent").alias("antecedent")).where("anaphor is not null and antecedent is not null")


def word_pairs(spark: SparkSession, path: str, heads: bool = True) -> DataFrame:
    """A word-pair resource as a multimap: anaphor, antecedents. With heads, only the parts after the last underscore."""
    rows = seeds(spark, path)
    if heads:
        rows = rows.select(C.head_key(F.col("anaphor")).alias("anaphor"), C.head_key(F.col("antecedent")).alias("antecedent"))
    return rows.groupBy("anaphor").agg(F.collect_list("antecedent").alias("antecedents"))


def demonyms(spark: SparkSession, path: str) -> DataFrame:
    """place, demonym; lines with fewer than two fields are skipped, of a place named twice the later line holds."""
    f = F.split("line", "\t")
    rows = _numbered(spark, path).where(F.size(f) >= 2).select("line_no", F.trim(f[0]).alias("place"), F.trim(f[1]).alias("demonym"))
    return rows.groupBy("place").agg(F.max_by("demonym", "line_no").alias("demonym"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """word, vector from lines of a word and its numbers."""
    f = F.split(F.trim("value"), " ")
    return _lines(spark, path).where(F.size(f) > 1).select(f[0].alias("word"), F.slice(f, F.lit(2), F.size(f) - 1).cast("array<float>").alias("vector"))


def word_list(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    w = F.trim("value")
    return _lines(spark, path).select((F.lower(w) if lower else w).alias("word")).where("word <> ''").distinct()


def json_map(spark: SparkSession, path: str, value: str = "double") -> DataFrame:
    """key, value of a JSON object, such as argument ratios."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def nested_counts(spark: SparkSession, path: str) -> DataFrame:
    """pattern, anaphor, antecedent, cnt from JSON pattern -> word 1 -> word 2 -> count, a file being one object of any size; of the
    words the anaphor is the one whose slot Y comes first."""
    rows = spans.nested_entries(spark, path).select(F.col("keys")[0].alias("pattern"), F.col("keys")[1].alias("w1"), F.col("keys")[2].alias("w2"), F.col("value").alias("cnt"))
    first = C.anaphor_slot_first(F.col("pattern"))
    return rows.select("pattern", F.when(first, F.col("w1")).otherwise(F.col("w2")).alias("anaphor"), F.when(first, F.col("w2")).otherwise(F.col("w1")).alias("antecedent"), "cnt")


def features(spark: SparkSession, path: str, without: list[str] | None = None) -> DataFrame:
    """key, name, value of mention features in JSON, without the named ones."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "m"))
    out = whole.select("key", F.explode("m").alias("name", "value"))
    return out.where(~F.col("name").isin(*without)) if without else out


def links(spark: SparkSession, path: str) -> DataFrame:
    """Gold or system links: doc (file name without its last ending), anaphor_text, anaphor, antecedent_text and
    antecedents, the ids of the fourth column."""
    rows = spark.read.schema("a string, b string, c string, d string").csv(path, sep="\t", quote="", recursiveFileLookup=True).withColumn("file", F.input_file_name())
    name = F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")
    return rows.select(name.alias("doc"), F.col("a").alias("anaphor_text"), F.col("b").alias("anaphor"), F.col("c").alias("antecedent_text"), F.split("d", r"\|").alias("antecedents")).where("anaphor is not null")


def gold_pairs(spark: SparkSession, path: str) -> DataFrame:
    """anaphor, antecedent of gold files (columns 1 and 3, phrases), cut to their heads; repeats kept."""
    rows = spark.read.schema("a string, b string, c string").csv(path, sep="\t", quote="", recursiveFileLookup=True)
    return rows.where("a is not null and c is not null").select(C.head_key(F.trim("a")).alias("anaphor"), C.head_key(F.trim("c")).alias("antecedent"))


def all_words(spark: SparkSession, path: str) -> DataFrame:
    """Heads of all words of a file of pairs or words, repeats kept."""
    return _lines(spark, path).select(F.explode(F.split(F.trim("value"), r"(?U)\s+")).alias("w")).where("w <> ''").select(C.head_key(F.col("w")).alias("word"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.trim("value").alias("pattern")).where("pattern <> ''")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Role sets of frame files: roleset, name, source, classes (an array), roles (n, description) and examples (name,
    text, rel, args of n and words). A part that a role set lacks is null, or an empty array."""
    piece = "array<struct<_VALUE string, _n string>>"
    schema = f"_id string, _name string, _source string, _vncls string, roles struct<role array<struct<_n string, _descr string>>>, example array<struct<_name string, text string, arg {piece}, rel {piece}>>"
    rows = spark.read.option("rowTag", "roleset").schema(schema).xml(path)
    many = lambda c, f: F.coalesce(F.transform(c, f), F.array())
    example = lambda e: F.struct(
        e["_name"].alias("name"), F.trim(e["text"]).alias("text"), F.trim(F.try_element_at(e["rel"], F.lit(1))["_VALUE"]).alias("rel"), many(e["arg"], lambda a: F.struct(a["_n"].alias("n"), F.trim(a["_VALUE"]).alias("words"))).alias("args")
    )
    classes = F.filter(F.split(F.coalesce("_vncls", F.lit("")), " "), lambda x: ~x.isin("", "-"))
    return rows.select(
        F.col("_id").alias("roleset"), F.col("_name").alias("name"), F.col("_source").alias("source"), classes.alias("classes"),
        many("roles.role", lambda r: F.struct(r["_n"].alias("n"), r["_descr"].alias("description"))).alias("roles"), many("example", example).alias("examples"),
    )


#: Signs of the relations in the data files of the lexical net.
RELATIONS = {
    "!": "antonym", "@": "hypernym", "@i": "instance_hypernym", "~": "hyponym", "~i": "instance_hyponym", "#m": "member_holonym", "#s": "substance_holonym", "#p": "part_holonym",
    "%m": "member_meronym", "%s": "substance_meronym", "%p": "part_meronym", "=": "attribute", "+": "derivation",
}


def _net_lines(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """Lines of a file of the lexical net without its licence, whose lines begin with a blank, and their fields."""
    return _lines(spark, path).where("value <> '' and not startswith(value, ' ')"), F.split(F.trim(F.substring_index("value", "|", 1)), " +")


def lexical_net(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """lemmas (synset, lemma) and edges (synset, rel, target) of data files of the lexical net. A synset is named by its
    part of speech and offset; relations without a name in RELATIONS keep their sign."""
    rows, f = _net_lines(spark, path)
    words = F.conv(f[3], 16, 10).cast("int")
    name = lambda pos, offset: F.concat(F.when(pos == "s", "a").otherwise(pos), offset)
    at = 5 + 2 * words
    nodes = rows.select(name(f[2], f[0]).alias("synset"), f.alias("f"), words.alias("words"), at.alias("at"))
    lemma = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda k: F.lower(F.element_at("f", 5 + 2 * k)))
    lemmas = nodes.select("synset", F.explode(lemma).alias("lemma")).distinct()
    count = F.element_at("f", F.col("at")).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    item = lambda k, j: F.element_at("f", F.col("at") + 4 * k + j)
    edge = F.transform(places, lambda k: F.struct(item(k, 1).alias("sign"), name(item(k, 3), item(k, 2)).alias("target")))
    names = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    edges = nodes.select("synset", F.explode(edge).alias("e")).select("synset", F.coalesce(F.try_element_at(names, F.col("e.sign")), "e.sign").alias("rel"), "e.target")
    return lemmas, edges.distinct()


def senses(spark: SparkSession, path: str) -> DataFrame:
    """lemma, rank (from 1, the commonest sense first) and synset of index files of the lexical net."""
    rows, f = _net_lines(spark, path)
    n = f[2].cast("int")
    return rows.select(f[0].alias("lemma"), f[1].alias("pos"), F.posexplode(F.slice(f, F.size(f) - n + 1, n)).alias("k", "offset")).select("lemma", (F.col("k") + 1).alias("rank"), F.concat("pos", "offset").alias("synset"))


def sexpressions(spark: SparkSession, path: str) -> DataFrame:
    """Nested lists of any depth: file, entry (number of the top-level list, from 1), pos, list (position of the bracket
    that opens the list around the item), depth of that list, and item. An item that is itself a list is an opening
    bracket, so its items are the rows whose list is its pos. Quotes around an item are taken off; what stands outside of
    all brackets is left out."""
    token = F.regexp_extract_all(F.regexp_replace("value", "\ufffd", ""), F.lit(r'("[^"]*"|[()]|[^\s()"]+)'), 1)
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(token).alias("pos", "t"))
    order = Window.partitionBy("file").orderBy("pos")
    step = F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0)
    t = t.withColumn("after", F.sum(step).over(order))
    t = t.withColumn("entry", F.count_if((F.col("t") == "(") & (F.col("after") == 1)).over(order)).where("t <> ')'")
    # a bracket is an item of the list around it, and opens the items one level further in
    opens = F.col("t") == "("
    both = F.when(opens, F.array(F.struct((F.col("after") - 1).alias("depth"), F.lit(None).cast("int").alias("open")), F.struct(F.col("after").alias("depth"), F.col("pos").alias("open"))))
    t = t.select("file", "entry", "pos", "t", F.inline(F.coalesce(both, F.array(F.struct(F.col("after").alias("depth"), F.lit(None).cast("int").alias("open"))))))
    t = t.withColumn("list", F.last("open", ignorenulls=True).over(Window.partitionBy("file", "entry", "depth").orderBy("pos")))
    return t.where("open is null and depth > 0").select("file", "entry", "pos", "list", F.col("depth").cast("int").alias("depth"), F.regexp_replace("t", '^"|"$', "").alias("item"))


def propositions(spark: SparkSession, path: str) -> DataFrame:
    """Proposition lines: file, tree, token, lemma, sense and pieces, an array of (label, tags, chain), a chain being an
    array of concatenations of (token, height)."""
    f = F.split(F.trim("value"), r"\s+")
    node = lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("token"), F.split(p, ":")[1].cast("int").alias("height"))
    piece = F.transform(
        F.slice(f, F.lit(6), F.greatest(F.size(f) - 5, F.lit(0))),
        lambda x: F.struct(F.split(x, "-")[1].alias("label"), F.slice(F.split(x, "-"), F.lit(3), F.lit(9)).alias("tags"), F.transform(F.split(F.split(x, "-")[0], r"\*"), lambda c: F.transform(F.split(c, ","), node)).alias("chain")),
    )
    return _lines(spark, path).where(F.size(f) >= 5).select(f[0].alias("file"), f[1].cast("int").alias("tree"), f[2].cast("int").alias("token"), f[3].alias("lemma"), f[4].alias("sense"), piece.alias("pieces"))


def morphology(spark: SparkSession, path: str) -> DataFrame:
    """base, variant from lines of a base form and its variants."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where(F.size(f) > 1).select(f[0].alias("base"), F.explode(F.slice(f, F.lit(2), F.size(f) - 1)).alias("variant"))


def adverb_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of adverb dictionaries: class, orth, adverbs, features (every :FEATURES part of an entry).
    Features that hold lists within lists within lists are left out; ``sexpressions`` reads any depth."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=\([A-Z]+)")).alias("e")).where("trim(e) <> ''")
    quoted = lambda c: F.regexp_extract_all(c, F.lit('"([^"]*)"'), 1)
    return whole.select(
        F.regexp_extract("e", r"^\(\s*([A-Z]+)", 1).alias("class"), F.regexp_extract("e", r':ORTH\s+"([^"]*)"', 1).alias("orth"),
        F.flatten(F.transform(F.regexp_extract_all("e", F.lit(r":ADV\s+(\([^)]*\)|\"[^\"]*\")"), 1), quoted)).alias("adverbs"),
        F.regexp_extract_all("e", F.lit(r":FEATURES\s+(\((?:[^()]|\([^()]*\))*\))"), 1).alias("features"),
    )


def addresses(spark: SparkSession, path: str) -> DataFrame:
    """Fields of space-separated lines, such as word lists or addresses."""
    return _lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("fields")).where("fields[0] <> ''")
