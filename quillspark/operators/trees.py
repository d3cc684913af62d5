"""Annotated documents: sentences, constituents, mentions, names, heads, stand-off alignment and cluster columns.

All start from the words of ``sources.readers.conll``. Keys: doc (file and number of the document in it), sent. Spans are
word numbers from 0 and inclusive. Every window and join has the sentence among its keys, so that no task holds more
than its share of sentences; what is collected is at most a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import lexicons as L
from quillspark.operators import brackets
from quillspark.operators import mentions as M

SENT = ["doc", "sent"]
#: Labels of constituents in which a head is looked for.
HEADED = ["NP", "PRP", "PRP$"]


def keyed(words: DataFrame) -> DataFrame:
    """Words whose doc is one string of file and number."""
    return words.withColumn("doc", F.concat_ws("#", "file", "doc"))


def name_spans(words: DataFrame) -> DataFrame:
    """Words with ``name``: the label that a bracket in the ner column opens, up to the token that closes it; else ``*``."""
    label = F.nullif(F.regexp_extract("ner", r"\(([^()*]+)", 1), F.lit(""))
    rows = words.withColumns({"n_label": label, "n_close": F.endswith("ner", F.lit(")")).cast("int")})
    rows = rows.withColumn("n_group", F.count("n_label").over(Window.partitionBy(*SENT).orderBy("word_idx")))
    in_group = Window.partitionBy(*SENT, "n_group").orderBy("word_idx")
    closed = F.coalesce(F.sum("n_close").over(in_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = F.when((F.col("n_group") > 0) & (closed == 0), F.first("n_label").over(in_group)).otherwise("*")
    return rows.withColumn("name", shown).drop("n_label", "n_close", "n_group")


def sentences(words: DataFrame) -> DataFrame:
    """doc, sent, tokens, tags, names in word order."""
    one = F.struct("word_idx", "token", "pos", "name")
    got = name_spans(words).groupBy(*SENT).agg(F.array_sort(F.collect_list(one)).alias("w"))
    return got.select(*SENT, F.col("w.token").alias("tokens"), F.col("w.pos").alias("tags"), F.col("w.name").alias("names"))


def _slice(c: str) -> Column:
    return F.slice(c, F.col("start") + 1, F.col("end") - F.col("start") + 1)


def as_rows(words: DataFrame) -> DataFrame:
    """doc, sent, places, tokens, tags, bits: sentences for ``brackets.nodes``, words in order."""
    got = words.groupBy(*SENT).agg(F.array_sort(F.collect_list(F.struct("word_idx", "token", "pos", "parse_bit"))).alias("w"))
    return got.select(*SENT, F.col("w.word_idx").alias("places"), F.col("w.token").alias("tokens"), F.col("w.pos").alias("tags"), F.col("w.parse_bit").alias("bits"))


def constituents(words: DataFrame) -> DataFrame:
    """doc, sent, node (number in pre-order from 1), parent (null at a root), label, depth, start, end, leaf, mirror
    (number in the pre-order that goes from right to left) and text. Every word is a leaf labelled with its tag.

    In a bracketing the opening and the closing of a node are neighbours among the brackets of their depth. A node
    never closed is left out. Words are shuffled once, to their sentences."""
    return brackets.nodes(as_rows(words)).drop("head")


def head_nodes(nodes: DataFrame) -> DataFrame:
    """doc, sent, node, noun (last of the direct children with a noun tag, as text), phrase (the last direct child that
    is a noun phrase) of every node that has one of the two."""
    noun, phrase = F.col("leaf") & F.col("label").isin(*L.NOUN_TAGS), (F.col("label") == "NP") & ~F.col("leaf")
    kids = nodes.where(F.col("parent").isNotNull() & (noun | phrase))
    return kids.groupBy(*SENT, F.col("parent").alias("node")).agg(F.max_by("text", F.when(noun, F.col("node"))).alias("noun"), F.max(F.when(phrase, F.col("node"))).alias("phrase"))


def _last_noun(tokens: Column, tags: Column) -> Column:
    found = F.array_compact(F.zip_with(tokens, tags, lambda w, t: F.when(t.isin(*L.NOUN_TAGS), w)))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.try_element_at(tokens, F.lit(-1)))


def phrase_heads(words: DataFrame) -> DataFrame:
    """doc, sent, node, head of every constituent: its last noun child; else the head of its last noun phrase child; else
    its last noun, else its last word."""
    return brackets.nodes(as_rows(words)).select(*SENT, "node", "head")


def coref_spans(words: DataFrame, crosswise: bool = False) -> DataFrame:
    """doc, sent, start, end, chain, k: spans of the coref column and their number in append order. Nested spans of one
    chain are paired as brackets are; with crosswise, the n-th opening goes with the n-th closing."""
    item = words.select(*SENT, "word_idx", F.posexplode(F.split("coref", r"\|")).alias("p", "item"))
    item = item.withColumn("chain", F.regexp_extract("item", r"(\d+)", 1)).where("chain <> ''")
    opened, closed = F.startswith("item", F.lit("(")), F.endswith("item", F.lit(")"))
    both = F.concat(F.when(opened, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(closed, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    ev = item.select(*SENT, "word_idx", "p", F.col("chain").cast("int").alias("chain"), F.posexplode(both).alias("q", "step"))
    w = Window.partitionBy(*SENT, "chain")
    order = ["word_idx", "p", "q"]
    if crosswise:
        ev = ev.withColumn("n", F.row_number().over(Window.partitionBy(*SENT, "chain", "step").orderBy(*order)))
        a = ev.where("step = 1").select(*SENT, "chain", "n", F.col("word_idx").alias("start"), "p")
        span = a.join(ev.where("step = -1").select(*SENT, "chain", "n", F.col("word_idx").alias("end")), [*SENT, "chain", "n"])
    else:
        ev = ev.withColumn("level", F.sum("step").over(w.orderBy(*order)) + F.when(F.col("step") == 1, 0).otherwise(1))
        span = ev.withColumn("end", F.lead("word_idx").over(Window.partitionBy(*SENT, "chain", "level").orderBy(*order))).where("step = 1 and end is not null").withColumnRenamed("word_idx", "start")
    span = span.withColumn("opened", F.min(F.struct("start", "p")).over(w))
    k = F.row_number().over(Window.partitionBy(*SENT).orderBy("opened", F.desc("start"), F.desc("p"), F.desc("end")))
    return span.select(*SENT, "start", "end", "chain", k.alias("k"))


def _described(spans: DataFrame, sents: DataFrame) -> DataFrame:
    """Spans with tokens, tags and the head by tags."""
    out = spans.join(sents, SENT).select(spans["*"], _slice("tokens").alias("tokens"), _slice("tags").alias("tags"), _slice("names").alias("names"))
    return out.withColumn("head", C.pos_head(F.col("tokens"), F.col("tags")))


def _with_head_facts(df: DataFrame) -> DataFrame:
    at = F.greatest(F.array_position("tokens", F.col("head")).cast("int"), F.lit(1))
    return df.withColumns({"head_tag": F.try_element_at("tags", at), "ner": F.try_element_at("names", at), "head_idx": F.col("start") + at - 1}).drop("names")


def mentions(words: DataFrame, *, crosswise: bool = False, head_mode: str = "legacy") -> DataFrame:
    """doc, ment, sent, start, end, tokens, tags, head, head_tag, head_idx, ner, chain, ord, l2r, r2l of the spans of the
    coref column. ord is the list order; l2r and r2l number a sentence's mentions by the constituent with the same text
    in either pre-order, those without one last.

    Heads: without a constituent, or with one whose label is not in HEADED, by tags. ``legacy``: a noun child of the
    constituent, else by tags if it has a noun phrase child, else its last noun. ``tree``: noun phrase children are
    followed down."""
    if head_mode not in ("legacy", "tree"):
        raise ValueError(f"head_mode {head_mode!r}")
    sents, nodes = sentences(words), constituents(words)
    m = _described(coref_spans(words, crosswise), sents).withColumn("text", C.spoken(F.col("tokens")))
    n = F.count("*").over(Window.partitionBy(*SENT))
    m = m.withColumn("ord", F.row_number().over(Window.partitionBy(*SENT).orderBy(M.reversed_append_order(F.col("k"), n))) - 1)
    first = nodes.groupBy(*SENT, "text").agg(F.min("node").alias("node"), F.min_by("mirror", "node").alias("mirror"), F.min_by("label", "node").alias("label"))
    m = m.join(first, [*SENT, "text"], "left")
    if head_mode == "tree":
        m = m.join(phrase_heads(words).withColumnRenamed("head", "t_head"), [*SENT, "node"], "left")
        found = F.col("t_head")
    else:
        m = m.join(head_nodes(nodes), [*SENT, "node"], "left")
        found = F.when(F.col("noun").isNotNull(), F.col("noun")).when(F.col("phrase").isNull(), _last_noun(F.col("tokens"), F.col("tags")))
    m = m.withColumn("head", F.when(F.col("label").isin(*HEADED) & (F.size("tokens") > 1), F.coalesce(found, "head")).otherwise(F.col("head")))
    rank = lambda c: F.row_number().over(Window.partitionBy(*SENT).orderBy(F.col(c).asc_nulls_last(), "ord")) - 1
    m = _with_head_facts(m).withColumns({"l2r": rank("node"), "r2l": rank("mirror"), "ment": F.concat_ws(":", "sent", "start", "end", "chain")})
    return m.select("doc", "ment", "sent", "start", "end", "tokens", "tags", "head", "head_tag", "head_idx", "ner", "chain", "ord", "l2r", "r2l")


def file_name(path: Column) -> Column:
    """Name of a file without folders and endings, by which documents and their annotation meet."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\..*$", "")


def align(mentions: DataFrame, markables: DataFrame, words: DataFrame) -> DataFrame:
    """Mentions with markable, is_status, mediated_type, bridge_type and antecedents of the markable with the same span.
    A markable without a mention becomes one, without chain, its head by tags, after the others of its sentence. words:
    with file, doc, offset; markables: with file; files meet by name."""
    place = words.select(file_name(F.col("file")).alias("name"), "offset", "doc", "sent", "word_idx")
    mark = markables.select(file_name(F.col("file")).alias("name"), F.col("id").alias("markable"), "span_start", "span_end", "is_status", "mediated_type", "bridge_type", "antecedents")
    s = place.select("name", F.col("offset").alias("span_start"), "doc", "sent", F.col("word_idx").alias("start"))
    e = place.select("name", F.col("offset").alias("span_end"), F.col("word_idx").alias("end"))
    mark = mark.join(s, ["name", "span_start"]).join(e, ["name", "span_end"]).drop("name", "span_start", "span_end")
    span = [*SENT, "start", "end"]
    known = mentions.join(mark, span, "left")
    new = _with_head_facts(_described(mark.where("end >= start").join(mentions.select(*span).distinct(), span, "left_anti"), sentences(words)))
    after = F.row_number().over(Window.partitionBy(*SENT).orderBy("start", "end", "markable")) + (1 << 20)
    new = new.withColumns({"ord": after, "l2r": after, "r2l": after, "chain": F.lit(None).cast("int"), "ment": F.concat_ws(":", "sent", "start", "end", "markable")})
    return known.unionByName(new.select(*known.columns))


def gold_links(aligned: DataFrame) -> DataFrame:
    """doc, anaphor, anaphor_ment, k, antecedent (markable ids), antecedent_ment, texts, heads, chain_ids, chain_heads:
    the antecedents of every anaphor, k from 0. Of mentions with the same markable id the last in order stands for it.
    chain_ids are the markable ids of all mentions of the antecedent's chain, itself included."""
    facts = aligned.where("markable is not null").withColumn("text", C.spoken(F.col("tokens")))
    one = facts.groupBy("doc", "markable").agg(F.max_by(F.struct("ment", "text", "head", "chain"), F.struct("sent", "ord")).alias("m"))
    chains = facts.where("chain is not null").groupBy("doc", "chain").agg(F.array_sort(F.collect_list(F.struct("sent", "start", "end", "markable", "head"))).alias("l"))
    t = one.select("doc", F.col("markable").alias("antecedent"), F.col("m.ment").alias("antecedent_ment"), F.col("m.text").alias("antecedent_text"), F.col("m.head").alias("antecedent_head"), F.col("m.chain").alias("chain")).join(chains, ["doc", "chain"], "left")
    a = facts.where(F.size("antecedents") > 0).select("doc", F.col("markable").alias("anaphor"), F.col("ment").alias("anaphor_ment"), F.col("text").alias("anaphor_text"), F.col("head").alias("anaphor_head"), F.posexplode("antecedents").alias("k", "antecedent"))
    out = a.join(t, ["doc", "antecedent"])
    return out.withColumns({"chain_ids": F.coalesce("l.markable", F.array("antecedent")), "chain_heads": F.coalesce("l.head", F.array("antecedent_head"))}).drop("l", "chain")


def gold_clusters(mentions: DataFrame) -> DataFrame:
    """doc, chain, members: mentions of each chain in text order."""
    rows = mentions.where("chain is not null").groupBy("doc", "chain").agg(F.array_sort(F.collect_list(F.struct("sent", "start", "end", "ment"))).alias("l"))
    return rows.select("doc", "chain", F.col("l.ment").alias("members"))


def noun_phrases(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """doc, ment of the mentions whose constituent, the first of the sentence with their text, is labelled as nominal."""
    first = constituents(words).groupBy(*SENT, "text").agg(F.min_by("label", "node").alias("label")).where(F.startswith("label", F.lit("N")))
    return mentions.withColumn("text", C.spoken(F.col("tokens"))).join(first, [*SENT, "text"]).select("doc", "ment")


def seed_pairs(links: DataFrame, heads: bool = True, phrases: DataFrame | None = None) -> DataFrame:
    """anaphor, antecedent: distinct word pairs of gold links, heads or phrases joined by underscores. With ``phrases``
    (doc, ment), only of links both of whose mentions are among them. Links without a head give no pair of heads."""
    if phrases is not None:
        for side in ("anaphor_ment", "antecedent_ment"):
            links = links.join(phrases.select("doc", F.col("ment").alias(side)), ["doc", side], "left_semi")
    if heads:
        links = links.where("anaphor_head is not null and antecedent_head is not null")
    a, t = ("anaphor_head", "antecedent_head") if heads else ("anaphor_text", "antecedent_text")
    return links.select(F.replace(F.col(a), F.lit(" "), F.lit("_")).alias("anaphor"), F.replace(F.col(t), F.lit(" "), F.lit("_")).alias("antecedent")).distinct()


def cluster_column(mentions: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """doc, sent, word_idx, new_coref: ``(id``, ``id)`` and ``(id)`` joined by bars, of all words at which mentions
    begin or end. clusters: doc, ment, cluster (numbers); without, mentions have them. Mentions without cluster get fresh ids in text order,
    from the highest of the document + 1. At a word, long spans open first and short ones close first."""
    m = mentions.select("doc", "ment", "sent", "start", "end", *(["cluster"] if clusters is None else []))
    if clusters is not None:
        m = m.join(clusters.select("doc", "ment", "cluster"), ["doc", "ment"], "left")
    alone = F.col("cluster").isNull().alias("alone")
    m = m.select("*", alone).withColumn("top", F.coalesce(F.max("cluster").over(Window.partitionBy("doc")), F.lit(0)))
    fresh = F.col("top") + F.row_number().over(Window.partitionBy("doc", "alone").orderBy("sent", "start", "end", "ment"))
    n = F.col("cluster").cast("string")
    ev = F.when(F.col("start") == F.col("end"), F.array(F.struct(F.col("start").alias("word_idx"), F.lit(1).alias("g"), F.lit(0).alias("o"), F.concat(F.lit("("), n, F.lit(")")).alias("s")))).otherwise(
        F.array(F.struct(F.col("start").alias("word_idx"), F.lit(0).alias("g"), (-F.col("end")).alias("o"), F.concat(F.lit("("), n).alias("s")), F.struct(F.col("end").alias("word_idx"), F.lit(2).alias("g"), (-F.col("start")).alias("o"), F.concat(n, F.lit(")")).alias("s"))))
    all_ = m.withColumn("cluster", F.coalesce("cluster", fresh))
    rows = all_.select("doc", "sent", F.inline(ev)).groupBy("doc", "sent", "word_idx").agg(F.array_sort(F.collect_list(F.struct("g", "o", "s"))).alias("l"))
    return rows.select("doc", "sent", "word_idx", F.array_join("l.s", "|").alias("new_coref"))


def with_clusters(words: DataFrame, mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Words with the column new_coref, ``-`` where no mention begins or ends, for ``writers.conll``."""
    got = cluster_column(mentions, clusters)
    return words.join(got, ["doc", "sent", "word_idx"], "left").withColumn("new_coref", F.coalesce("new_coref", F.lit("-")))


def subject_verbs(words: DataFrame) -> DataFrame:
    """doc, sent, clause, subject, verb: for every S node the head of its last noun phrase child and its last verb, a child
    or grandchild of a verb phrase child; clauses without one of the two are left out."""
    nodes = constituents(words)
    heads = phrase_heads(words)
    s = nodes.where("label = 'S' and not leaf").select(*SENT, F.col("node").alias("clause"))
    kid = nodes.where("not leaf").select(*SENT, F.col("parent").alias("clause"), "node", "label").join(s, [*SENT, "clause"])
    subj = kid.where("label = 'NP'").groupBy(*SENT, "clause").agg(F.max("node").alias("node")).join(heads, [*SENT, "node"]).select(*SENT, "clause", F.col("head").alias("subject"))
    vp = kid.where("label = 'VP'").select(*SENT, "clause", F.col("node").alias("parent"))
    under = vp.join(nodes.select(*SENT, "parent", "node", "label", "text"), [*SENT, "parent"])
    deeper = under.where(~F.startswith("label", F.lit("VB"))).select(*SENT, "clause", F.col("node").alias("parent")).join(nodes.select(*SENT, "parent", "node", "label", "text"), [*SENT, "parent"])
    verb = under.unionByName(deeper).where(F.startswith("label", F.lit("VB"))).groupBy(*SENT, "clause").agg(F.max_by("text", "node").alias("verb"))
    return subj.join(verb, [*SENT, "clause"]).select(*SENT, "clause", "subject", "verb")


def adjacent_subjects(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc, sent, anaphor, antecedent, anaphor_verb, antecedent_verb: seed pairs whose antecedent is a subject of one
    sentence and whose anaphor is one of the next; case is ignored."""
    low = lambda c: F.lower(F.col(c))
    now = pairs.select("doc", "sent", low("subject").alias("a_low"), F.col("verb").alias("anaphor_verb"))
    before = pairs.select("doc", (F.col("sent") + 1).alias("sent"), low("subject").alias("t_low"), F.col("verb").alias("antecedent_verb"))
    s = seeds.select("anaphor", "antecedent", low("anaphor").alias("a_low"), low("antecedent").alias("t_low")).distinct()
    return now.join(s, "a_low").join(before, ["doc", "sent", "t_low"]).select("doc", "sent", "anaphor", "antecedent", "anaphor_verb", "antecedent_verb")


def seed_patterns(sents: DataFrame, seeds: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, sent, pattern, anaphor, antecedent: what stands between the first occurrence of one word of a seed pair and the
    last of the other, in either order, in the sentences that have both. X is the anaphor."""
    tok = sents.select(doc, "sent", F.explode(F.array_distinct("tokens")).alias("anaphor"))
    s = seeds.select("anaphor", "antecedent").distinct()
    both = tok.join(s, "anaphor").join(tok.withColumnRenamed("anaphor", "antecedent"), [doc, "sent", "antecedent"]).join(sents.select(doc, "sent", "tokens"), [doc, "sent"])

    def between(a: str, b: str, left: str, right: str) -> Column:
        p = F.array_position("tokens", F.col(a)).cast("int")
        q = (F.size("tokens") + 1 - F.array_position(F.reverse("tokens"), F.col(b))).cast("int")
        gap = F.array_join(F.slice("tokens", p + 1, q - p - 1), " ")
        return F.when(q > p, F.concat_ws(" ", F.lit(left), F.nullif(gap, F.lit("")), F.lit(right)))

    found = F.array_compact(F.array(between("anaphor", "antecedent", "<X>", "<Y>"), between("antecedent", "anaphor", "<Y>", "<X>")))
    return both.select(doc, "sent", F.explode(found).alias("pattern"), "anaphor", "antecedent")


def attach_tokens(mentions: DataFrame, annotation: DataFrame) -> DataFrame:
    """Mentions with ``dep`` of the annotated token at their head: annotation has doc, sent, word_idx, dep."""
    return mentions.join(annotation.select("doc", "sent", F.col("word_idx").alias("head_idx"), "dep"), ["doc", "sent", "head_idx"], "left")
