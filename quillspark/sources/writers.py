"""Writers. Tables between stages are Parquet; text formats exist for tools that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, *columns: str, order: list[str] | None = None) -> None:
    """Tab-separated lines of the columns, nulls as empty fields."""
    if order:
        df = df.orderBy(*order)
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value")).write.text(path)


def conll_lines(words: DataFrame) -> DataFrame:
    """file, line_no, value: CoNLL rows with the column ``new_coref`` last, header, blank and end lines in place."""
    fields = ["file_field", "part", "word_idx", "token", "pos", "parse_bit", "pred_lemma", "frame_id", "word_sense", "speaker", "ner"]
    have = [F.col(c).cast("string") if c in words.columns else F.lit("-") for c in fields]
    row = F.concat_ws("\t", *have, F.array_join("pred_args", "\t"), F.col("new_coref"))
    row = F.regexp_replace(row, "\t\t", "\t")
    last = F.lead("sent").over(Window.partitionBy("file", "doc").orderBy("offset"))
    first = F.lag("sent").over(Window.partitionBy("file", "doc").orderBy("offset"))
    put = F.concat(
        F.when(first.isNull(), F.array(F.col("header"))).otherwise(F.array().cast("array<string>")), F.array(row),
        F.when(last.isNull(), F.array(F.lit(""), F.lit("#end document"))).when(last != F.col("sent"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
    )
    rows = words.withColumn("put", put).select("file", "offset", F.posexplode("put").alias("k", "value"))
    return rows.select("file", (F.col("offset") * 4 + F.col("k")).alias("line_no"), "value")


def conll(words: DataFrame, path: str) -> None:
    """Writes ``conll_lines``, the lines of a file together and in order."""
    conll_lines(words).repartition("file").sortWithinPartitions("file", "line_no").select("value").write.text(path)


def gold_lines(pairs: DataFrame, heads: bool = False) -> DataFrame:
    """value: anaphor, its id, antecedent, ids of the antecedent's whole chain joined by a bar. pairs: anaphor_text,
    anaphor, antecedent_text, chain_ids, and with heads anaphor_head and chain_heads instead of the texts."""
    a, t = (("anaphor_head", F.array_join("chain_heads", ";")) if heads else ("anaphor_text", F.col("antecedent_text")))
    return pairs.select(F.concat_ws("\t", F.col(a), "anaphor", t, F.array_join("chain_ids", "|")).alias("value"))


def system_lines(pairs: DataFrame) -> DataFrame:
    """value: the links of which both sides have a markable id."""
    return pairs.where("anaphor is not null and antecedent is not null").select(F.concat_ws("\t", "anaphor_text", "anaphor", "antecedent_text", "antecedent").alias("value"))


def bootstrapped(result, spark, path: str) -> None:
    """patterns, wordpairs, anaphors and antecedents of a bootstrapping run, one folder each."""
    p = spark.createDataFrame(result.patterns or [("", 0.0, 0)], "pattern string, score double, round int").where("pattern <> ''")
    w = spark.createDataFrame(result.pairs or [("", "", 0.0, 0)], "anaphor string, antecedent string, score double, round int").where("anaphor <> ''")
    lines(p, f"{path}/patterns", "pattern", order=["round"])
    lines(w, f"{path}/wordpairs", "anaphor", "antecedent", order=["round", "anaphor"])
    lines(w.select("anaphor").distinct(), f"{path}/anaphors", "anaphor", order=["anaphor"])
    lines(w.select("antecedent").distinct(), f"{path}/antecedents", "antecedent", order=["antecedent"])


def seeds(pairs: DataFrame, path: str) -> None:
    lines(pairs, path, "anaphor", "antecedent")


def features(rows: DataFrame, path: str) -> None:
    """One JSON object for each mention."""
    rows.write.json(path)


def cache(df: DataFrame, path: str) -> DataFrame:
    """Writes a table as Parquet and returns what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generalised(pairs: DataFrame, mapping: DataFrame, path: str) -> None:
    """Pairs of classes for pairs of words, ``null`` where a word has none."""
    a = mapping.select(F.col("word").alias("anaphor"), F.col("synset").alias("sa"))
    t = mapping.select(F.col("word").alias("antecedent"), F.col("synset").alias("st"))
    out = pairs.join(a, "anaphor", "left").join(t, "antecedent", "left")
    lines(out.select(F.coalesce("sa", F.lit("null")).alias("sa"), F.coalesce("st", F.lit("null")).alias("st")), path, "sa", "st")


def word_dump(pairs: DataFrame, path: str) -> None:
    """Anaphor and antecedent of each pair, a line each."""
    pairs.select(F.explode(F.array("anaphor", "antecedent")).alias("value")).write.text(path)


def report(scores: DataFrame) -> DataFrame:
    """One row of text with the scores of ``operators.evaluation.score_links``."""
    one = lambda k: F.format_string("%s P %.4f R %.4f F %.4f", F.lit(k), f"{k}_precision", f"{k}_recall", f"{k}_f1")
    return scores.select(F.concat_ws("\n", one("link"), one("anaphor")).alias("report"))
