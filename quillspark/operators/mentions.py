"""Mentions and joins between them: backward searches, windows, filters, features.

Tables: mentions(doc, ment, sent, start, end, tokens, head, ord), positions from 0 and inclusive. Every join has the
document, and where it can the sentence, as equality key; of several matches the first is kept by an aggregate that the
engine combines before the shuffle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import store
from quillspark.functions import columns as C
from quillspark.functions import lexicons as L
from quillspark.operators import patterns, resources


def from_noun_runs(df: DataFrame, doc: str, sent: str) -> DataFrame:
    """Mentions of untagged text: the noun runs of each row (doc, sent, text), head = last token."""
    rows = df.select(F.col(doc).alias("doc"), F.col(sent).alias("sent"), F.regexp_extract_all("text", F.lit(r"([\p{L}]+|,)"), 1).alias("words"))
    rows = patterns.noun_runs(patterns.tag_closed_class(patterns.settled(rows.withColumnRenamed("words", "tokens"))), drop_last=False)
    one = rows.select("doc", "sent", "tokens", F.posexplode("runs").alias("k", "r"))
    span = F.slice("tokens", F.col("r.a"), F.col("r.b") - F.col("r.a") + 1)
    return one.select("doc", "sent", "k", (F.col("r.a") - 1).alias("start"), (F.col("r.b") - 1).alias("end"), span.alias("tokens")).withColumns({"head": F.element_at("tokens", -1), "ord": F.col("k"), "ment": F.concat_ws(":", "sent", "k")}).drop("k")


def reversed_append_order(k: Column, n: Column) -> Column:
    """Sort key of the mention appended k-th (from 1) of n when the list is reversed after every append."""
    return F.when((n - k) % 2 == 0, F.struct(F.lit(0).alias("g"), (-k).alias("o"))).otherwise(F.struct(F.lit(1).alias("g"), k.alias("o")))


def with_lexicon_key(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mentions whose tokens include a key of the lexicon (anaphor, antecedent): adds ``word``, the first such token."""
    keys = lexicon.select(F.col("anaphor").alias("w")).distinct()
    hits = mentions.select("doc", "ment", F.posexplode("tokens").alias("p", "w")).join(keys, "w", "left_semi")
    first = hits.groupBy("doc", "ment").agg(F.min_by("w", "p").alias("word"))
    return mentions.join(first, ["doc", "ment"])


#: Sentences before its own in which a lookup tests the words that are there; in those further back it looks for all its antecedents.
NEAR = 8

#: Rows of a table of words or pairs that are sent to all tasks at a time.
BLOCK = 1 << 20


def blocks(table: DataFrame, *keys: str, rows: int | None = None) -> list[DataFrame]:
    """``table`` by a hash of its keys in parts of about BLOCK rows, each of which can be sent to all tasks."""
    n = -(-table.count() // (rows or BLOCK)) or 1
    return [table if n == 1 else table.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == k) for k in range(n)]


def meeting(rows: DataFrame, parts: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    """A join with the table that ``parts`` are ``blocks`` of, sent to all tasks if it is one."""
    return rows.join(F.broadcast(parts[0]) if len(parts) == 1 else functools.reduce(DataFrame.unionByName, parts), on, how)


def _looked_up(mentions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentences (doc, sent, lookups, words): mentions with a lexicon key (``word``, their first such token), and the antecedents of keys
    among the words of all mentions. Mentions are dealt out once, by sentence; what they hold of the lexicon is told there."""
    sides = F.array(F.struct(F.col("anaphor").alias("w"), F.lit(True).alias("key"), F.lit(False).alias("ante")), F.struct(F.col("antecedent").alias("w"), F.lit(False).alias("key"), F.col("anaphor").isNotNull().alias("ante")))
    known = store.kept(lexicon.select(F.inline(sides)).where("w is not null").groupBy("w").agg(F.max("key").alias("key"), F.max("ante").alias("ante")))
    dealt = mentions.select("doc", "sent", "ment", "ord", "start", "end", "tokens").repartition("doc", "sent")
    tokens = meeting(dealt.select("doc", "sent", "ment", "ord", "start", "end", F.posexplode("tokens").alias("p", "w")), blocks(known, "w"), ["w"])
    one = tokens.groupBy("doc", "sent", "ment", "ord", "start", "end").agg(F.min(F.when(F.col("key"), F.struct("p", "w"))).alias("first"), F.collect_set(F.when(F.col("ante"), F.col("w"))).alias("ws"))
    lookup = F.when(F.col("first").isNotNull(), F.struct(F.col("ment").alias("anaphor"), F.col("start").alias("at"), F.col("first.w").alias("word")))
    words = F.transform("ws", lambda w: F.struct(F.struct("ord", "ment").alias("own"), "end", w.alias("w")))
    return one.groupBy("doc", "sent").agg(F.collect_list(lookup).alias("lookups"), F.flatten(F.collect_list(words)).alias("words"))


def backward_search(mentions: DataFrame, lexicon: DataFrame, *, min_sent: int = 1, near: int = NEAR) -> DataFrame:
    """doc, anaphor, antecedent: for each mention with a lexicon key the nearest earlier mention with one of the key's
    antecedents: own sentence first, then sentences backwards down to min_sent, within one by mention order.

    The words of its own sentence, then of the one before, then of the others of ``near`` are held against the lexicon, which costs
    what the sentences hold, however many antecedents a key has. The lexicon comes to where they are, in ``blocks`` one after the other:
    a row for a lookup and a word is never sent on, only the best of each lookup is. What is found in none of the sentences and has
    others further back looks there for each of its antecedents, in one order of lookups and words."""
    lexicon = store.once(lexicon)
    pairs = store.kept(lexicon.select(F.col("anaphor").alias("word"), F.col("antecedent").alias("w")).where("word is not null and w is not null").distinct())
    parts = blocks(pairs, "word", "w")
    sents = store.kept(_looked_up(mentions, lexicon))
    words = sents.where(F.size("words") > 0).select("doc", F.col("sent").alias("place"), "words")
    first = F.struct((-F.col("place")).alias("s"), "own").alias("best")

    def tested(rows: DataFrame, earlier: Callable[[Column], Column]) -> DataFrame:
        """The best of what ``words`` of each row's ``place`` hold."""
        made = rows.select("doc", "anaphor", "word", "place", F.explode(F.filter("words", earlier)).alias("x")).select("doc", "anaphor", "word", "place", "x.w", "x.own")
        best = [store.kept(made.join(F.broadcast(part), ["word", "w"], "left_semi").groupBy("doc", "anaphor").agg(F.min(first).alias("best"))) for part in parts]
        return best[0] if len(best) == 1 else store.kept(functools.reduce(DataFrame.unionByName, best).groupBy("doc", "anaphor").agg(F.min("best").alias("best")))

    found = [tested(sents.where(F.size("words") > 0).select("doc", F.col("sent").alias("place"), F.explode("lookups").alias("l"), "words").select("doc", "place", "words", "l.*"), lambda x: x["end"] < F.col("at"))]
    lookups = sents.where(F.col("sent") - 1 >= min_sent).select("doc", "sent", F.inline("lookups")).select("doc", "anaphor", "sent", "word")
    left = store.kept(lookups.join(found[0], ["doc", "anaphor"], "left_anti"))
    for lo, hi in ((1, 1), (2, near)):
        places = F.explode(F.sequence(F.col("sent") - F.lit(lo), F.greatest(F.col("sent") - F.lit(hi), F.lit(min_sent).cast(mentions.schema["sent"].dataType))))
        found.append(tested(left.select("*", places.alias("place")).join(words, ["doc", "place"]), lambda x: F.lit(True)))
        left = store.kept(left.where(F.col("sent") - hi - 1 >= min_sent).join(found[-1], ["doc", "anaphor"], "left_anti"))
    if not left.isEmpty():
        found.append(_far(left, words, pairs, min_sent, near))
    return functools.reduce(DataFrame.unionByName, found).select("doc", "anaphor", F.col("best.own.ment").alias("antecedent"))


def _far(lookups: DataFrame, words: DataFrame, pairs: DataFrame, min_sent: int, near: int) -> DataFrame:
    """doc, anaphor, best of lookups (doc, anaphor, sent, word) by what lies more than ``near`` sentences back. Lookups and the words
    looked for are put in one order for each (doc, word), and each lookup takes what came last before it."""
    asked = lookups.join(pairs, "word").select("doc", "w", (F.col("sent") - near).alias("sent"), F.lit(0).alias("kind"), "anaphor")
    docs = lookups.select("doc").distinct()
    there = words.where(F.col("place") >= min_sent).join(docs, "doc", "left_semi").select("doc", F.col("place").alias("sent"), F.inline("words")).groupBy("doc", "w", "sent").agg(F.min("own").alias("own"))
    rows = asked.unionByName(there.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # a sentence's words come after the lookups that stop before it
    order = Window.partitionBy("doc", "w").orderBy("sent", "kind").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == 1, F.struct((-F.col("sent")).alias("s"), "own")), ignorenulls=True).over(order)
    return rows.withColumn("best", last).where("kind = 0 and best is not null").groupBy("doc", "anaphor").agg(F.min("best").alias("best"))


#: Sentences of a document that are dealt out together, with those before them that their windows reach.
SPAN = 64


def candidate_window(mentions: DataFrame, n: int = 2, *, min_sent: int = 0, carry: str | tuple[str, ...] | None = None) -> DataFrame:
    """doc, anaphor, antecedent, distance: earlier mentions of the same sentence and all of the n before. Columns ``carry`` come along
    for both, as a_ and t_ before their names. Mentions are dealt out by runs of sentences, those near the end of a run also to the next, which a join with
    the two adds, and pairs are made there."""
    more = (carry,) if isinstance(carry, str) else carry or ()
    run = lambda c: F.floor(c / max(SPAN, n))
    two = F.broadcast(mentions.sparkSession.range(2).withColumnRenamed("id", "further"))
    rows = mentions.where("doc is not null and sent is not null").join(two, F.col("further") <= run(F.col("sent") + n) - run(F.col("sent")))
    rows = rows.select("doc", "sent", "ment", "start", "end", *more, (run(F.col("sent")) + F.col("further")).alias("run"))
    near = Window.partitionBy("doc", "run").orderBy("sent").rangeBetween(-n, 0)
    rows = rows.withColumn("near", F.collect_list(F.struct("sent", "ment", "end", *more)).over(near)).where(run(F.col("sent")) == F.col("run"))
    rows = rows.select("doc", F.col("ment").alias("anaphor"), "sent", "start", *(F.col(c).alias(f"a_{c}") for c in more), F.explode("near").alias("t"))
    ok = (F.col("t.sent") < F.col("sent")) & (F.col("t.sent") >= max(min_sent, 0)) | (F.col("t.sent") == F.col("sent")) & (F.col("t.end") < F.col("start"))
    return rows.where(ok).select("doc", "anaphor", F.col("t.ment").alias("antecedent"), (F.col("sent") - F.col("t.sent")).alias("distance"), *(F.col(f"a_{c}") for c in more), *(F.col(f"t.{c}").alias(f"t_{c}") for c in more))


def best_candidate(scored: DataFrame) -> DataFrame:
    """The candidate with the highest score above 0 for each anaphor; ties to the nearer sentence, then mention order."""
    return scored.where("score > 0").groupBy("doc", "anaphor").agg(F.max_by("antecedent", F.struct("score", -F.col("distance"), -F.col("ord"))).alias("antecedent"))


def numbered(mentions: DataFrame) -> DataFrame:
    """Sentences (doc, sent, inside, before): a sentence's mentions in text order and how many the document has before it."""
    inside = F.array_sort(F.collect_list(F.struct("start", "ment", "end")))
    sents = mentions.groupBy("doc", "sent").agg(inside.alias("inside"))
    earlier = Window.partitionBy("doc").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    return sents.withColumn("before", F.coalesce(F.sum(F.size("inside")).over(earlier), F.lit(0)))


def ranks(sents: DataFrame) -> DataFrame:
    """Mentions of ``numbered`` sentences by number (doc, rank, ment), from 0."""
    return sents.select("doc", "before", F.posexplode("inside").alias("k", "m")).select("doc", (F.col("before") + F.col("k")).alias("rank"), F.col("m.ment").alias("ment"))


def between(pairs: DataFrame, mentions: DataFrame, sents: DataFrame | None = None) -> DataFrame:
    """pairs (doc, anaphor, antecedent) with ``n_between``, the number of mentions after the antecedent's end and before the anaphor's
    start; ``first``, the number in its document of the first of them; and, in text order, ``tail``: those in the anaphor's
    sentence. The others have the numbers from ``first`` on. What lies between is counted, not listed. Pairs meet what is known of
    their antecedents as one number each; the list of a sentence is met last, so that no list is sent on with a pair."""
    sents = numbered(mentions) if sents is None else sents
    upto = F.transform("inside", lambda x: F.struct(x["ment"].alias("antecedent"), x["end"].alias("te"), (F.col("before") + F.size(F.filter("inside", lambda m: m["start"] <= x["end"]))).alias("first")))
    antecedents = sents.select("doc", F.col("sent").alias("ts"), F.inline(upto))
    p = pairs.join(antecedents, ["doc", "antecedent"])
    p = p.join(mentions.select("doc", F.col("ment").alias("anaphor"), F.col("sent").alias("as"), F.col("start").alias("ab")), ["doc", "anaphor"])
    p = p.join(sents.select("doc", F.col("sent").alias("as"), F.col("inside").alias("own"), F.col("before").alias("own_before")), ["doc", "as"])
    earlier = F.col("ts") < F.col("as")
    tail = F.transform(F.filter("own", lambda m: (m["end"] < F.col("ab")) & (earlier | ((F.col("ts") == F.col("as")) & (m["start"] > F.col("te")))) & (m["ment"] != F.col("anaphor")) & (m["ment"] != F.col("antecedent"))), lambda m: m["ment"])
    p = p.withColumns({"n_before": F.when(earlier, F.col("own_before") - F.col("first")).otherwise(0), "tail": tail})
    return p.select("doc", "anaphor", "antecedent", (F.col("n_before") + F.size("tail")).cast("int").alias("n_between"), "first", F.col("n_before").cast("int").alias("n_before"), "tail")


def draws(n: Column, k: int, *key: Column) -> Column:
    """An array of k different numbers from 0 to n - 1, by a hash of the key; n is k at least."""
    hashes = F.array(*(F.conv(F.substring(F.md5(F.concat_ws("|", *key, F.lit(str(j)))), 1, 8), 16, 10).cast("long") for j in range(k)))
    # each steps over what the smaller ones drawn before have taken
    free = lambda drawn, h: F.aggregate(F.array_sort(drawn), F.pmod(h, F.greatest(n - F.size(drawn), F.lit(1))), lambda x, taken: x + (x >= taken).cast("long"))
    return F.aggregate(hashes, F.array().cast("array<bigint>"), lambda drawn, h: F.concat(drawn, F.array(free(drawn, h))))


def negatives(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Negative pairs by the number of mentions between: 1 gives (anaphor, m0), 2 (m1, m0), 3 (m0, antecedent) and
    (m2, m1), more two pairs of four mentions drawn by a hash. Only the mentions needed are looked up, by their number."""
    sents = store.kept(numbered(mentions))
    m = between(pairs, mentions, sents)
    n = F.col("n_between")
    some = draws(n, 4, F.col("doc").cast("string"), F.col("anaphor"), F.col("antecedent"))
    wanted = F.when(n >= 4, some).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).cast("array<bigint>"))
    # what is in the anaphor's sentence is taken from its list here, so that the list ends here
    one = F.transform(wanted, lambda i: F.struct(F.when(i < F.col("n_before"), F.col("first") + i).alias("rank"), F.get("tail", (i - F.col("n_before")).cast("int")).alias("near")))
    one = m.where("n_between > 0").select("doc", "anaphor", "antecedent", "n_between", F.posexplode(one).alias("k", "x")).select("doc", "anaphor", "antecedent", "n_between", "k", "x.rank", "x.near")
    far = one.join(ranks(sents).withColumnRenamed("ment", "far"), ["doc", "rank"], "left")
    found = far.withColumn("m", F.coalesce("far", "near"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("m")))
    got = found.groupBy("doc", "anaphor", "antecedent", "n_between").agg(*(at(k).alias(f"m{k}") for k in range(4)))
    pair = lambda a, t: F.struct(F.col(a).alias("anaphor"), F.col(t).alias("antecedent"))
    made = (
        F.when(n == 1, F.array(pair("anaphor", "m0"))).when(n == 2, F.array(pair("m1", "m0")))
        .when(n == 3, F.array(pair("m0", "antecedent"), pair("m2", "m1"))).otherwise(F.array(pair("m0", "m1"), pair("m2", "m3")))
    )
    return got.select("doc", F.inline(made))


def containing_others(mentions: DataFrame) -> DataFrame:
    """doc, ment of the mentions whose text has another mention of the sentence as a proper part."""
    a = mentions.select("doc", "sent", "ment", C.spoken(F.col("tokens")).alias("s"))
    b = a.select("doc", "sent", F.col("s").alias("other")).distinct()
    return a.join(b, ["doc", "sent"]).where((F.col("s") != F.col("other")) & F.contains("s", F.col("other"))).select("doc", "ment").distinct()


def possible_anaphors(mentions: DataFrame) -> DataFrame:
    """Mentions that can be anaphors: head no pronoun, no comparative, no other mention inside, head no proper noun."""
    ok = ~F.lower("head").isin(*L.PRONOUN_HEADS) & ~C.overlaps(F.col("tokens"), L.COMPARATIVES)
    if "head_tag" in mentions.columns:
        ok &= ~F.startswith("head_tag", F.lit("NNP"))
    return mentions.where(ok).join(containing_others(mentions), ["doc", "ment"], "left_anti")


def containment(mentions: DataFrame) -> DataFrame:
    """Adds has_child and is_child: another mention of the sentence lies within, or around it."""
    a = mentions.select("doc", "sent", "ment", "start", "end")
    b = a.select("doc", "sent", F.col("ment").alias("o"), F.col("start").alias("os"), F.col("end").alias("oe"))
    inside = a.join(b, ["doc", "sent"]).where((F.col("ment") != F.col("o")) & (F.col("os") >= F.col("start")) & (F.col("oe") <= F.col("end")) & ((F.col("os") != F.col("start")) | (F.col("oe") != F.col("end"))))
    parent = inside.select("doc", "ment").distinct().withColumn("has_child", F.lit(True))
    child = inside.select("doc", F.col("o").alias("ment")).distinct().withColumn("is_child", F.lit(True))
    out = mentions.join(parent, ["doc", "ment"], "left").join(child, ["doc", "ment"], "left")
    return out.withColumns({"has_child": F.coalesce("has_child", F.lit(False)), "is_child": F.coalesce("is_child", F.lit(False))})


def previous_features(mentions: DataFrame) -> DataFrame:
    """Adds features of earlier mentions in the document: first of the document and of the sentence, number of earlier
    ones with the same text and with the same head, and their bins. Counts are ranks within equal texts and heads."""
    order = ["sent", "start", "end"]
    same = lambda *k: F.rank().over(Window.partitionBy("doc", *k).orderBy(*order)) - 1
    # all windows are of a document's rows, so these are dealt out once
    out = mentions.where("doc is not null and sent is not null").repartition("doc").withColumn("text", C.spoken(F.col("tokens")))
    out = out.withColumns({"same_text": same("text"), "same_head": same("head"), "f": F.min(F.struct(*order)).over(Window.partitionBy("doc")), "fs": F.min("start").over(Window.partitionBy("doc", "sent"))})
    return out.withColumns({
        "doc_first": F.struct(*order) == F.col("f"), "sent_first": F.col("start") == F.col("fs"), "fullprevment": F.col("same_text") > 0, "fullprevtime": C.count_bin(F.col("same_text")),
        "partialpre": F.col("same_head") > 0, "partialtime": C.count_bin(F.col("same_head")),
    }).drop("f", "fs")


def surface_features(mentions: DataFrame) -> DataFrame:
    """Adds features of a mention by itself."""
    pre = C.premodifiers(F.col("tokens"), F.col("head"))
    out = mentions.withColumns({
        "len_anaphor": C.length_bin(F.size("tokens")), "definite": C.has_definite(F.col("tokens")), "determiner_first": C.determiner_first(F.col("tokens")), "determiner": C.determiner_class(pre),
        "no_premod_comp": ~C.overlaps(F.col("tokens"), L.COMPARATIVES), "spatial_temporal_mod": C.overlaps(F.col("tokens"), L.SPATIAL_TEMPORAL), "premod_gen_quant": C.overlaps(pre, L.QUANTIFIERS),
        "is_year": C.is_year(F.col("head")), "set_element": C.is_set_element(F.col("head"), pre),
    })
    if "tags" in mentions.columns:
        out = out.withColumns({"anaphor_pp": C.has_preposition(F.col("tags")), "np_type": C.np_type(F.col("head_tag"), F.col("head")), "np_num": C.np_number(F.col("head_tag")), "content": C.content_words(F.col("tokens"), F.col("tags"))})
    return out


def sides(mentions: DataFrame, lexicon: DataFrame, top_terms: DataFrame | None = None, general: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Mentions with ``side`` in place of their words: what features of pairs take from one mention, made once for each mention and not for each pair."""
    heads = mentions.select("head").distinct()
    facts = [F.col("tokens"), F.col("head"), F.size(C.premodifiers(F.col("tokens"), F.col("head"))).alias("n_pre"), *(F.col(c) for c in ("head_tag", "ner") if c in mentions.columns)]
    out = mentions
    if "tags" in mentions.columns:
        out = out.withColumns({"pp": C.has_preposition(F.col("tags")), "number": C.overlaps(F.transform("tokens", F.lower), L.SMALL_NUMBERS)}).drop("tags")
        facts += [F.col("pp"), F.col("number")]
    if top_terms is not None:
        tops = top_terms.groupBy("doc").agg(F.collect_set("token").alias("tops"))
        heads = heads.join(lexicon.select(F.col("anaphor").alias("head")).distinct().withColumn("is_key", F.lit(True)), "head", "left")
        # the terms end here, so that none are sent on with a mention
        out = out.join(tops, "doc", "left").withColumn("top", F.coalesce(F.arrays_overlap("tokens", "tops"), F.lit(False))).drop("tops")
        facts += [F.col("top"), F.coalesce("is_key", F.lit(False)).alias("is_key")]
    if general is not None:
        heads = heads.join(general.groupBy(F.col("word").alias("head")).agg(F.array_sort(F.collect_set("synset")).alias("general")), "head", "left")
        facts.append(F.col("general"))
    if paths is not None:
        up = paths.groupBy("word", "synset").agg(F.min("depth").alias("d")).groupBy(F.col("word").alias("head")).agg(F.collect_list(F.struct("synset", "d")).alias("up"))
        heads = heads.join(up, "head", "left")
        facts.append(F.col("up"))
    if len(heads.columns) > 1:
        out = out.join(heads, "head", "left")
    return out.select(*(c for c in mentions.columns if c not in ("tokens", "tags", "head", "head_tag", "ner")), F.struct(*facts).alias("side"))


#: Most blocks of a table of known pairs that are sent to all tasks together.
MOST = 8


def _flagged(pairs: DataFrame, known: DataFrame, on: list[str], flags: list[str]) -> DataFrame:
    """``pairs`` with ``flags`` of the row of ``known``, false without one. ``known`` comes to the pairs, which stay where they are, unless it has more than
    MOST blocks."""
    parts = blocks(known, *on)
    parts = [F.broadcast(p) for p in parts] if len(parts) <= MOST else [known]
    out = pairs.withColumns(dict.fromkeys(flags, F.lit(False)))
    for part in parts:
        out = out.join(part.withColumnsRenamed({f: f"k_{f}" for f in flags}), on, "left").withColumns({f: F.coalesce(f"k_{f}", f) for f in flags}).drop(*(f"k_{f}" for f in flags))
    return out


def pair_features(pairs: DataFrame | Callable[[DataFrame], DataFrame], mentions: DataFrame, lexicon: DataFrame, top_terms: DataFrame | None = None, *, general: DataFrame | None = None, general_pairs: DataFrame | None = None, net: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Features of (doc, anaphor, antecedent): lexicon, preposition, determiner, lengths, heads and tf-idf flags; with
    ``general`` (word, synset) and ``general_pairs`` (anaphor, antecedent, as synsets) whether the pair of their
    generalisations is known; with ``net``, that is lemmas (synset, lemma), edges (synset, rel, target) and hypernym
    paths (word, synset, depth), part-of relations and the level of similarity.

    What one mention gives is made by mention, if mentions do not have it as ``side`` already. ``pairs`` may be a function that
    makes them from mentions with ``side``, carried as a_side and t_side: no join by mention follows then, and no pair is shuffled, as the tables
    of known pairs of heads come to where pairs are made."""
    both = general is not None and general_pairs is not None
    m = mentions if "side" in mentions.columns else store.kept(sides(mentions, lexicon, top_terms, general if both else None, net[2] if net else None))

    given = m.schema["side"].dataType.names
    tags, ner = "pp" in given, "ner" in given

    def placed(m: DataFrame) -> DataFrame:
        if callable(pairs):
            return pairs(m)
        out = pairs
        for k, name in (("a", "anaphor"), ("t", "antecedent")):
            out = out.join(m.select("doc", F.col("ment").alias(name), F.col("side").alias(f"{k}_side")), ["doc", name])
        return out

    a, t = F.col("a_side"), F.col("t_side")
    out = placed(m).withColumns({"a_head": a["head"], "t_head": t["head"]})
    known = lexicon.select(F.col("anaphor").alias("a_head"), F.col("antecedent").alias("t_head"), F.lit(True).alias("pair_in_resource"), F.lit(False).alias("meronym"))
    if net is not None:
        lemmas, edges, _ = net
        for of, kind in (("b", "meronym"), ("a", "holonym")):
            found = resources.relations(lemmas, edges, [f"part_{kind}", f"substance_{kind}", f"member_{kind}"], of=of)
            known = known.unionByName(found.select(F.col("a").alias("a_head"), F.col("b").alias("t_head"), F.lit(False).alias("pair_in_resource"), F.lit(True).alias("meronym")))
    flags = ["pair_in_resource", *(["meronym"] if net is not None else [])]
    out = _flagged(out, store.kept(known.groupBy("a_head", "t_head").agg(*(F.max(f).alias(f) for f in flags))), ["a_head", "t_head"], flags)
    if both:
        slim = m.withColumn("side", F.struct(F.col("side.general").alias("general")))
        groups = placed(slim).select(a["general"].alias("ga"), t["general"].alias("gt")).select("ga", "gt", F.explode("ga").alias("anaphor")).select("ga", "gt", "anaphor", F.explode("gt").alias("antecedent"))
        wanted = store.once(general_pairs)
        # only known ones among the pairs of generalisations are sent on, once each
        meet = [groups.join(F.broadcast(part), ["anaphor", "antecedent"], "left_semi").select("ga", "gt") for part in blocks(wanted, "anaphor", "antecedent")]
        meet = store.kept(functools.reduce(DataFrame.unionByName, meet).distinct().withColumn("generalized_resource", F.lit(True)))
        out = _flagged(out.withColumns({"ga": a["general"], "gt": t["general"]}), meet, ["ga", "gt"], ["generalized_resource"]).drop("ga", "gt")
    if net is not None:
        ways = F.flatten(F.transform(a["up"], lambda x: F.transform(F.filter(t["up"], lambda y: y["synset"] == x["synset"]), lambda y: x["d"] + y["d"])))
        out = out.withColumn("wn_dist", C.similarity_bin(C.leacock_chodorow(F.array_min(ways), resources.DEPTH)))
    if top_terms is not None:
        out = out.withColumns({"tfidf_ante": t["top"], "ante_tfidf_anap_resource": a["is_key"] & t["top"]})
    out = out.withColumns({
        "definite": C.has_definite(a["tokens"]), "determiner": C.determiner_first(a["tokens"]), "len_anaphor": C.length_bin(F.size(a["tokens"])), "len_antecedent": C.length_bin(F.size(t["tokens"])),
        "anaphor_head_in_ante": F.array_contains(t["tokens"], F.col("a_head")) & (F.col("a_head") != F.col("t_head")), "ante_head_in_anaphor": F.array_position(a["tokens"], F.lower("t_head")).between(1, a["n_pre"]), "same_head": F.col("a_head") == F.col("t_head"),
    })
    if tags:
        out = out.withColumns({"anaphor_pp": a["pp"], "number_plural": a["number"] & t["head_tag"].isin("NNS", "NNPS")})
    if ner:
        out = out.withColumn("ante_ne_anap_head", F.concat_ws("-", F.coalesce(t["ner"], F.lit("*")), "a_head"))
    return out.drop("a_side", "t_side")


def generalized_resource(pairs: DataFrame, general: DataFrame, general_pairs: DataFrame) -> DataFrame:
    """Adds generalized_resource to pairs with a_head and t_head: the pair of their synsets, by ``general`` (word,
    synset), is in ``general_pairs`` (anaphor, antecedent). A word without synset is in no such pair."""
    # from the heads at hand to their synsets: all words under a known pair of synsets would be many more
    heads = pairs.select("a_head", "t_head").distinct()
    heads = heads.join(general.select(F.col("word").alias("a_head"), F.col("synset").alias("anaphor")), "a_head").join(general.select(F.col("word").alias("t_head"), F.col("synset").alias("antecedent")), "t_head")
    known = heads.join(general_pairs, ["anaphor", "antecedent"], "left_semi").select("a_head", "t_head").distinct().withColumn("generalized_resource", F.lit(True))
    return pairs.join(known, ["a_head", "t_head"], "left").withColumn("generalized_resource", F.coalesce("generalized_resource", F.lit(False)))
