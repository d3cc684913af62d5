"""Lexical patterns between nouns, their counts and scores.

Extraction looks at one sentence at a time and needs no shuffle: noun runs, gaps and heads are array expressions. The
first shuffle is the count of (pattern, anaphor, antecedent), pre-aggregated by the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import lexicons as L
from quillspark.operators import vectors


def settled(df: DataFrame) -> DataFrame:
    """The same rows with every column computed once. Without it the optimizer would put an array's expression into
    each use of the array, also inside of functions that run for every element."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent, tokens): texts split at full stops and line feeds, then into runs of letters and commas."""
    cut = docs.select(key, F.posexplode(F.split("text", r"[.\n]+")).alias("sent", "sentence"))
    return settled(cut.select(key, "sent", F.regexp_extract_all("sentence", F.lit(r"([\p{L}]+|,)"), 1).alias("tokens"))).where(F.size("tokens") > 0)


def tag_closed_class(sents: DataFrame, closed: list[str] = L.CLOSED_CLASS) -> DataFrame:
    """Adds ``nouns``, an array of flags: all but closed-class words count as nouns where text has no tags."""
    return settled(sents.withColumn("nouns", F.transform("tokens", lambda t: ~F.lower(t).isin(*closed))))


def noun_runs(sents: DataFrame, *, drop_last: bool = True) -> DataFrame:
    """Adds ``runs``, an array of (a, b): first and last position, from 1, of each maximal run of nouns. With drop_last
    the last token of a sentence is not looked at."""
    n = F.size("tokens") - (1 if drop_last else 0)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    others = F.filter(places, lambda i: ~F.coalesce(F.try_element_at("nouns", i), F.lit(False)))
    cut = settled(sents.withColumn("runs_between", F.concat(F.array(F.lit(0)), others, F.array(n + 1))))
    k = F.size("runs_between") - 1
    between = F.zip_with(F.slice("runs_between", F.lit(1), k), F.slice("runs_between", F.lit(2), k), lambda p, q: F.struct((p + 1).alias("a"), (q - 1).alias("b")))
    return settled(cut.withColumn("runs", F.filter(between, lambda r: r["a"] <= r["b"])).drop("runs_between"))


def _head(a: Column, b: Column, useless: list[str]) -> Column:
    span = F.slice("tokens", a, b - a + 1)
    if useless:
        span = F.filter(span, lambda t: ~t.isin(*useless))
    return F.try_element_at(span, F.lit(-1))


def _gap(runs_a: Column, runs_b: Column, skip: list[str]) -> Column:
    """The words from one position to another, without those whose tag begins with one in ``skip``."""
    words = F.slice("tokens", runs_a, runs_b - runs_a)
    if not skip:
        return words
    tagged = F.arrays_zip(words.alias("w"), F.slice("tags", runs_a, runs_b - runs_a).alias("t"))
    return F.transform(F.filter(tagged, lambda x: ~F.rlike(x["t"], F.lit(f"^({'|'.join(skip)})"))), lambda x: x["w"])


def extract(sents: DataFrame, *, useless: list[str] | None = None, max_gap: int | None = 3, keep: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """(pattern, anaphor, antecedent), one row for each pair of neighbouring noun runs and direction: ``<Y> gap <X>``
    with the first run's head as anaphor, and ``<X> gap <Y>`` with the second's. Runs without a useful word, equal heads
    and gaps of more than max_gap words give none. Words of a gap whose tag matches one in ``skip``, such as
    ``lexicons.GAP_TAGS``, are left out of the pattern and not counted; that needs the column tags."""
    runs = noun_runs(sents)
    size = F.size("runs")
    pairs = F.zip_with(
        F.slice("runs", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("runs", F.lit(2), F.greatest(size - 1, F.lit(0))),
        lambda p, q: F.struct(_head(p["a"], p["b"], useless or []).alias("h1"), _head(q["a"], q["b"], useless or []).alias("h2"), _gap(p["b"] + 1, q["a"], skip or []).alias("gap")),
    )
    one = runs.select(*(keep or []), F.explode(pairs).alias("p")).select(*(keep or []), "p.*").where("h1 is not null and h2 is not null and h1 <> h2")
    if max_gap is not None:
        one = one.where(F.size("gap") <= max_gap)
    gap = F.array_join("gap", " ")
    both = F.array(
        F.struct(F.concat(F.lit("<Y> "), gap, F.lit(" <X>")).alias("pattern"), F.col("h1").alias("anaphor"), F.col("h2").alias("antecedent")),
        F.struct(F.concat(F.lit("<X> "), gap, F.lit(" <Y>")).alias("pattern"), F.col("h2").alias("anaphor"), F.col("h1").alias("antecedent")),
    )
    return one.select(*(keep or []), F.inline(both))


def candidates_v1(sents: DataFrame) -> DataFrame:
    """(pattern): every noun after a gap closes a pattern, so a run of k nouns also gives k - 1 patterns ``<Y> <X>``;
    each has its mirror. The last token of a sentence is not looked at."""
    runs = noun_runs(sents)
    size = F.size("runs")
    gaps = F.zip_with(F.slice("runs", F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice("runs", F.lit(2), F.greatest(size - 1, F.lit(0))), lambda p, q: F.array_join(F.slice("tokens", p["b"] + 1, q["a"] - p["b"] - 1), " "))
    inside = F.flatten(F.transform("runs", lambda r: F.when(r["b"] > r["a"], F.array_repeat(F.lit(""), r["b"] - r["a"])).otherwise(F.array().cast("array<string>"))))
    text = F.explode(F.concat(gaps, inside))
    one = runs.select(text.alias("gap")).select(F.when(F.col("gap") == "", " ").otherwise(F.concat(F.lit(" "), "gap", F.lit(" "))).alias("gap"))
    return one.select(F.explode(F.array(F.concat(F.lit("<Y>"), "gap", F.lit("<X>")), F.concat(F.lit("<X>"), "gap", F.lit("<Y>")))).alias("pattern"))


def count_extractions(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("pattern", "anaphor", "antecedent").agg(F.count("*").alias("cnt"))


def frequent(counts: DataFrame, more_than: int = 6) -> DataFrame:
    """pattern, total of the patterns with more than so many extractions."""
    return counts.groupBy("pattern").agg(F.sum("cnt").alias("total")).where(F.col("total") > more_than)


def prune(counts: DataFrame, more_than: int = 6, *, few: bool = False) -> DataFrame:
    """The counts of ``frequent`` patterns. ``few`` says that patterns are few, as gaps of closed-class
    words are however long the text: they are sent to the counts, which then stay where they are; else both meet by pattern."""
    good = frequent(counts, more_than).select("pattern")
    return counts.join(F.broadcast(good) if few else good, "pattern", "left_semi")


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Counts from JSON pattern -> word 1 -> word 2 -> count; of the words the anaphor is the one whose slot Y comes first."""
    parsed = df.select(F.from_json(column, "map<string,map<string,map<string,bigint>>>").alias("m"))
    rows = parsed.select(F.explode("m").alias("pattern", "m")).select("pattern", F.explode("m").alias("w1", "m")).select("pattern", "w1", F.explode("m").alias("w2", "cnt"))
    first = C.anaphor_slot_first(F.col("pattern"))
    return rows.select("pattern", F.when(first, F.col("w1")).otherwise(F.col("w2")).alias("anaphor"), F.when(first, F.col("w2")).otherwise(F.col("w1")).alias("antecedent"), "cnt")


def flag_hits(counts: DataFrame, lexicon: DataFrame, mode: str = "strict", ignore_case: bool = False) -> DataFrame:
    """Adds ``hit``: strict, the pair is in the lexicon; relaxed, its anaphor is some anaphor there and its antecedent
    some antecedent. Phrases are compared by the part after the last underscore."""
    def key(name: str) -> Column:
        k = C.head_key(F.col(name))
        return F.lower(k) if ignore_case or mode == "relaxed" else k

    lex = lexicon.select(key("anaphor").alias("la"), key("antecedent").alias("lt"))
    rows = counts.withColumns({"ka": key("anaphor"), "kt": key("antecedent")})
    if mode == "strict":
        lex = lex.distinct().withColumn("hit", F.lit(True))
        out = rows.join(lex, (rows.ka == lex.la) & (rows.kt == lex.lt), "left")
        return out.withColumn("hit", F.coalesce("hit", F.lit(False))).drop("ka", "kt", "la", "lt")
    a, t = lex.select(F.col("la")).distinct().withColumn("ha", F.lit(True)), lex.select(F.col("lt")).distinct().withColumn("ht", F.lit(True))
    out = rows.join(a, rows.ka == a.la, "left").join(t, rows.kt == t.lt, "left")
    return out.withColumn("hit", F.coalesce(F.col("ha") & F.col("ht"), F.lit(False))).drop("ka", "kt", "la", "lt", "ha", "ht")


def score_patterns(flagged: DataFrame) -> DataFrame:
    """pattern, hits, total and score = hits / total * ln(hits), 0 without hits; extractions count as often as found."""
    by = flagged.groupBy("pattern").agg(F.sum(F.when(F.col("hit"), F.col("cnt")).otherwise(0)).alias("hits"), F.sum("cnt").alias("total"))
    return by.withColumn("score", F.when(F.col("hits") > 0, F.col("hits") / F.col("total") * F.log("hits")).otherwise(F.lit(0.0)))


def score_pairs(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """anaphor, antecedent and the sum over the selected patterns, each given once, that extract them of 1 + score / 100. Only
    what they extract is shuffled."""
    pairs = counts.select("pattern", "anaphor", "antecedent").join(F.broadcast(selected.select("pattern", "score")), "pattern").distinct()
    return pairs.groupBy("anaphor", "antecedent").agg(F.sum(1 + 0.01 * F.col("score")).alias("score"))


def match_pattern(sents: DataFrame, pattern: str) -> DataFrame:
    """(sent columns, anaphor, antecedent): whole noun runs, joined by underscores, on both sides of the pattern's words.
    Gap words may be nouns and the last token of a sentence counts. A pattern without words matches nothing."""
    words = pattern.split()[1:-1]
    keys = [c for c in sents.columns if c not in ("tokens", "nouns")]
    if not words:
        return sents.select(*keys, F.lit("").alias("anaphor"), F.lit("").alias("antecedent")).where(F.lit(False))
    k, n = len(words), F.size("tokens")
    at = lambda i: F.coalesce(F.try_element_at("nouns", i), F.lit(False))
    places = F.when(n >= k + 2, F.sequence(F.lit(2), n - k)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda i: (F.slice("tokens", i, F.lit(k)) == F.array(*[F.lit(w) for w in words])) & at(i - 1) & at(i + k))
    rows = sents.select(*keys, "tokens", "nouns", F.explode(hits).alias("i"))
    before = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.col("i") - 1), lambda j: ~at(j))), F.lit(0))
    after = F.coalesce(F.array_min(F.filter(F.sequence(F.col("i") + k, F.size("tokens")), lambda j: ~at(j))), F.size("tokens") + 1)
    left = F.array_join(F.slice("tokens", before + 1, F.col("i") - 1 - before), "_")
    right = F.array_join(F.slice("tokens", F.col("i") + k, after - F.col("i") - k), "_")
    a, t = (left, right) if pattern.startswith("<Y>") else (right, left)
    return rows.select(*keys, a.alias("anaphor"), t.alias("antecedent"))


def compounds(sents: DataFrame) -> DataFrame:
    """Pairs of neighbouring nouns, lower case."""
    n = F.size("tokens")
    at = lambda i: F.coalesce(F.try_element_at("nouns", i), F.lit(False))
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(F.filter(places, lambda i: at(i) & at(i + 1)), lambda i: F.struct(F.lower(F.element_at("tokens", i + 1)).alias("anaphor"), F.lower(F.element_at("tokens", i)).alias("antecedent")))
    return sents.select(F.inline(pair))


def pair_counts(counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Anaphor, antecedent and count over the extractions of useful patterns."""
    return counts.join(patterns.select("pattern").distinct(), "pattern", "left_semi").groupBy("anaphor", "antecedent").agg(F.sum("cnt").alias("cnt"))


def vector_match(counts: DataFrame, lexicon: DataFrame, words: DataFrame, threshold: float = 0.7, strict: bool = False) -> DataFrame:
    """Adds ``hit``: some lexicon pair (strict), or some anaphor and some antecedent there (else), is as close as the
    threshold by cosine; words without a vector match nothing. words: (word, vector). Distinct words, or pairs, are held against
    all of the lexicon block by block, and only those that are close come back."""
    def placed(pairs: DataFrame, columns: list[str]) -> DataFrame:
        out = pairs.select(*columns).distinct()
        for c in columns:
            out = out.join(words.select(F.col("word").alias(c), F.col("vector").alias(f"{c}_vector")), c)
        return out

    def near(columns: list[str]) -> DataFrame:
        sides = [f"{c}_vector" for c in columns]
        found = vectors.close_rows(placed(counts, columns), placed(lexicon, columns), columns, sides, threshold)
        return found.select(*(F.col(c).alias(f"near_{c}") for c in columns), F.lit(True).alias(f"hit_{columns[0]}"))

    out, flags = counts, []
    for columns in [["anaphor", "antecedent"]] if strict else [["anaphor"], ["antecedent"]]:
        found = near(columns)
        out = out.join(found, [out[c] == found[f"near_{c}"] for c in columns], "left").drop(*(f"near_{c}" for c in columns))
        flags.append(f"hit_{columns[0]}")
    hit = F.coalesce(F.col(flags[0]), F.lit(False))
    for f in flags[1:]:
        hit &= F.coalesce(F.col(f), F.lit(False))
    return out.withColumn("hit", hit).drop(*flags)
