"""Features of mentions from their sentence, their chain, earlier mentions and word lists.

Word lists and gazetteers come as tables (word); they are joined, and the engine broadcasts them where they are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import lexicons as L

# Classes of heads that are no names, in the order in which their lists decide.
CLASSES = {"relative": "RelPer", "role": "RolePer", "person": "PERSON", "organisation": "ORG", "location": "LOC"}


def _flag(df: DataFrame, words: DataFrame, name: str, head: Column) -> DataFrame:
    known = words.where("word is not null").select(F.col("word").alias("l_word")).distinct().withColumn("l_hit", F.lit(True))
    return df.withColumn("l_head", head).join(known, F.col("l_head") == F.col("l_word"), "left").withColumn(name, F.coalesce("l_hit", F.lit(False))).drop("l_word", "l_hit", "l_head")


def list_flags(mentions: DataFrame, lists: dict[str, DataFrame], *, lower: bool = False) -> DataFrame:
    """Adds a truth value for each named list: whether the head is in it, as written, or with lower in lower case."""
    head = F.lower("head") if lower else F.col("head")
    for name, words in lists.items():
        mentions = _flag(mentions, words, name, head)
    return mentions


def semantic_class(mentions: DataFrame, lists: dict[str, DataFrame], *, lower: bool = False) -> DataFrame:
    """Adds sem_category: the kind of name of the head, else the label of the first of CLASSES whose list has the head, else ``NA``."""
    given = [c for c in CLASSES if c in lists]
    out = list_flags(mentions, {f"l_{c}": lists[c] for c in given}, lower=lower)
    cases = [F.nullif("ner", F.lit("*")), *(F.when(F.col(f"l_{c}"), CLASSES[c]) for c in given), F.lit("NA")]
    return out.withColumn("sem_category", F.coalesce(*cases)).drop(*(f"l_{c}" for c in given))


def argument_ratio(mentions: DataFrame, ratios: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds arg_ratio: whether the head's value in ratios (key, value) is above ``least``; false for unknown heads."""
    r = ratios.groupBy(F.col("key").alias("r_key")).agg(F.max("value").alias("r_value"))
    return mentions.join(r, F.col("head") == F.col("r_key"), "left").withColumn("arg_ratio", F.coalesce(F.col("r_value") > least, F.lit(False))).drop("r_key", "r_value")


def country_premodifiers(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Adds premod_countries: a token before the head is in the gazetteer (word)."""
    pre = mentions.select("doc", "ment", F.explode(C.premodifiers(F.col("tokens"), F.col("head"))).alias("word"))
    hit = pre.join(gazetteer.select("word").distinct(), "word", "left_semi").select("doc", "ment").distinct().withColumn("premod_countries", F.lit(True))
    return mentions.join(hit, ["doc", "ment"], "left").withColumn("premod_countries", F.coalesce("premod_countries", F.lit(False)))


def sentence_flags(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Adds ifclause and modalpresent: the sentence (doc, sent, tokens, tags) has the token ``if``, a tag MD."""
    s = sentences.select("doc", "sent", F.array_contains("tokens", "if").alias("ifclause"), F.array_contains("tags", "MD").alias("modalpresent"))
    out = mentions.join(s, ["doc", "sent"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("ifclause", "modalpresent")})


def chain_features(mentions: DataFrame) -> DataFrame:
    """Adds gold_chain_len (0 without chain) and coherence_gap: no chain, no comparative and no proper noun."""
    n = F.count("chain").over(Window.partitionBy("doc", "chain"))
    names = F.coalesce(F.exists("tags", lambda t: F.startswith(t, F.lit("NNP"))), F.lit(False))
    gap = F.col("chain").isNull() & ~C.overlaps(F.col("tokens"), L.COMPARATIVES) & ~names
    return mentions.withColumns({"gold_chain_len": F.when(F.col("chain").isNull(), F.lit(0)).otherwise(n).cast("int"), "coherence_gap": gap})


def earlier_content(mentions: DataFrame) -> DataFrame:
    """Adds contentpre: an earlier mention of the document has one of the mention's content words. A word's first place
    decides, so no pairs of mentions are made."""
    order = F.struct("sent", "start", "end", "ment")
    # a mention's words go to its document in one row and are told apart there
    dealt = mentions.where("doc is not null").select("doc", "ment", "sent", "start", "end", F.array_distinct(C.content_words(F.col("tokens"), F.col("tags"))).alias("words")).where(F.size("words") > 0).repartition("doc")
    w = dealt.select("doc", "ment", order.alias("at"), F.explode("words").alias("word"))
    w = w.withColumn("first", F.min("at").over(Window.partitionBy("doc", "word")))
    hit = w.where(F.col("word").isNotNull() & (F.col("first") < F.col("at"))).select("doc", "ment").distinct().withColumn("contentpre", F.lit(True))
    return mentions.join(hit, ["doc", "ment"], "left").withColumn("contentpre", F.coalesce("contentpre", F.lit(False)))
