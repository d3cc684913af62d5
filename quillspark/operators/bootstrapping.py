"""Growing a word-pair lexicon with patterns, round by round, by what each round changes.

What a new pair changes is found, not recounted. Extractions are written once as pairs with all their patterns, in the order of pairs, so
that a round reads the pages that hold its new pairs. Pairs that the same patterns extract score the same in every round and stand in the
order of their words: of those only as many as rounds can add are candidates, and a round scores the candidates of its patterns. Where very
many rounds are to come both tables are written again, in ranges of pairs and of patterns. A table of the patterns with hits is brought up
to date with what new pairs hit. Each round has the same jobs, whatever rounds came before; seeds stay a table, and the driver holds the
selected patterns and added pairs only, as many as rounds allow."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import store
from quillspark.functions import columns as C

#: Rows in a file of the ordered tables.
PART = 1 << 20
#: From so many rounds on tables in ranges cost less than looking into every file in each of them.
MANY = 64
#: From so many rounds on candidates cost less than scoring all pairs of the selected patterns in each of them.
SOME = 4
#: Of more candidates of a class than this Spark no longer keeps the first in each task before it brings a class together.
FIRST, PARTS = 1000, 64


@dataclass
class Bootstrapped:
    patterns: list[tuple[str, float, int]]
    pairs: list[tuple[str, str, float, int]]


def _key(name: str, mode: str) -> Column:
    k = C.head_key(F.col(name))
    return F.lower(k) if mode == "relaxed" else k


def _flagged(df: DataFrame, keys: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    """df with whether its columns ``on`` are in the distinct rows of ``keys``."""
    right = keys.select(*(F.col(k).alias(f"_{k}") for k in on.values())).distinct().withColumn(flag, F.lit(True))
    out = df.join(right, [df[c] == right[f"_{k}"] for c, k in on.items()], "left").drop(*(f"_{k}" for k in on.values()))
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _ordered(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Written in files that each hold a range of values."""
    return store.kept(df.repartitionByRange(n, *by).sortWithinPartitions(*by))


def grouped(counts: DataFrame) -> DataFrame:
    """anaphor, antecedent, their keys ka and kt, n and found (an array of pattern and cnt, by pattern) of every pair in counts (pattern, anaphor,
    antecedent, cnt), written in the order of pairs within each file."""
    by = Window.partitionBy("anaphor", "antecedent").orderBy("pattern")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counts.select("anaphor", "antecedent", F.collect_list(F.struct("pattern", "cnt")).over(whole).alias("found"), F.sum("cnt").over(whole).alias("n"), F.row_number().over(by).alias("nth")).where("nth = 1")
    return store.kept(out.select("anaphor", "antecedent", C.head_key(F.col("anaphor")).alias("ka"), C.head_key(F.col("antecedent")).alias("kt"), "n", "found"))


def candidates(pairs: DataFrame, most: int) -> DataFrame:
    """anaphor, antecedent and patterns of the first ``most`` pairs, by their words, of every class of pairs that the same patterns extract.
    No round can add another before these, as a class scores the same throughout."""
    rows = pairs.select("anaphor", "antecedent", F.array_distinct("found.pattern").alias("patterns")).withColumn("class", F.xxhash64("patterns"))
    for more in ([F.pmod(F.hash("anaphor", "antecedent"), F.lit(PARTS))], []) if most > FIRST else ([],):
        by = Window.partitionBy("class", "patterns", *more).orderBy("anaphor", "antecedent")
        rows = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most).drop("nth")
    return rows.drop("class")


@dataclass
class Postings:
    """Pairs by their keys, candidates by pattern, and what is hit by the seeds or the pairs added since."""

    mode: str
    heads: DataFrame
    totals: DataFrame
    by_pair: DataFrame
    by_antecedent: DataFrame | None
    by_pattern: DataFrame
    added: set = field(default_factory=set)
    anaphors: set = field(default_factory=set)
    antecedents: set = field(default_factory=set)

    def _flagged(self, rows: DataFrame) -> DataFrame:
        if self.mode == "strict":
            return _flagged(rows, self.heads, {"ka": "a", "kt": "t"}, "hit")
        low = self.heads.select(F.lower("a").alias("a"), F.lower("t").alias("t"))
        return _flagged(_flagged(rows, low, {"ka": "a"}, "a_hit"), low, {"kt": "t"}, "t_hit")

    def hits(self) -> DataFrame:
        """pattern, hits, total of the patterns with hits of seeds."""
        start = F.col("hit") if self.mode == "strict" else F.col("a_hit") & F.col("t_hit")
        return self._by_pattern(self._flagged(self.by_pair).where(start))

    def _by_pattern(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.inline("found")).groupBy("pattern").agg(F.sum("cnt").alias("hits")).join(self.totals, "pattern")

    def more_hits(self, keys: list[tuple[str, str]]) -> DataFrame | None:
        """What hits the patterns gain by pairs of keys not in the lexicon before."""
        if self.mode == "strict":
            new = [k for k in dict.fromkeys(keys) if k not in self.added]
            self.added.update(new)
            if not new:
                return None
            found = functools.reduce(Column.__or__, [(F.col("ka") == a) & (F.col("kt") == t) for a, t in new])
            near = F.col("ka").isin(sorted({a for a, _ in new})) & F.col("kt").isin(sorted({t for _, t in new}))
            return self._by_pattern(self._flagged(self.by_pair.where(near & found)).where(~F.col("hit")))
        new_a = sorted({a for a, _ in keys} - self.anaphors)
        new_t = sorted({t for _, t in keys} - self.antecedents)
        was = (F.col("a_hit") | F.col("ka").isin(self.anaphors)) & (F.col("t_hit") | F.col("kt").isin(self.antecedents))
        self.anaphors.update(new_a)
        self.antecedents.update(new_t)
        now = (F.col("a_hit") | F.col("ka").isin(self.anaphors)) & (F.col("t_hit") | F.col("kt").isin(self.antecedents))
        if not new_a and not new_t:
            return None
        rows = self.by_pair.where(F.col("ka").isin(new_a)).unionByName(self.by_antecedent.where(F.col("kt").isin(new_t) & ~F.col("ka").isin(new_a)))
        return self._by_pattern(self._flagged(rows).where(now & ~was))


def postings(pairs: DataFrame, seeds: DataFrame, mode: str = "strict", *, more_than: int = 0, most: int | None = None, ordered: bool = True) -> Postings:
    """The tables of what ``grouped`` gives for growing the lexicon ``seeds`` (anaphor, antecedent), with patterns of more than ``more_than``
    extractions and, with ``most``, so many candidates of a class."""
    heads = store.kept(seeds.select(C.head_key(F.col("anaphor")).alias("a"), C.head_key(F.col("antecedent")).alias("t")).distinct())
    totals = store.kept(pairs.select(F.inline("found")).groupBy("pattern").agg(F.sum("cnt").alias("total")).where(F.col("total") > more_than))
    unknown = _flagged(pairs, heads, {"anaphor": "a", "antecedent": "t"}, "known").where(~F.col("known"))
    if most is None:
        found = unknown.select(F.explode(F.array_distinct("found.pattern")).alias("pattern"), "anaphor", "antecedent")
    else:
        found = candidates(unknown, most).select(F.explode("patterns").alias("pattern"), "anaphor", "antecedent")
    keyed = pairs.select(*(F.lower(k).alias(k) if mode == "relaxed" else k for k in ("ka", "kt")), "found")
    if not ordered:
        return Postings(mode, heads, totals, keyed, keyed if mode == "relaxed" else None, found if most is None else store.kept(found))
    n = max(1, -(-pairs.count() // PART))
    by_pair = _ordered(keyed, n, "ka", "kt")
    by_antecedent = _ordered(by_pair, n, "kt", "ka") if mode == "relaxed" else None
    return Postings(mode, heads, totals, by_pair, by_antecedent, _ordered(found, n, "pattern", "anaphor", "antecedent"))


def _scored(state: DataFrame, digits: int) -> DataFrame:
    return state.select("pattern", F.round(F.col("hits") / F.col("total") * F.log("hits"), digits).alias("score")).where("score > 0")


def bootstrap(counts: DataFrame, seeds: DataFrame, *, rounds: int = 200, per_round: int = 10, mode: str = "strict", frozen: bool = False, at_least: int = 0, digits: int = 12, more_than: int = 0) -> Bootstrapped:
    """Grows a lexicon from seeds over counts, or what ``grouped`` makes of them: each round scores all patterns against it, selects the best new one, scores the pairs
    of all selected patterns and adds the best new ones. ``frozen`` keeps the score a pattern had when selected. With ``at_least``
    pairs are added only in rounds with more scored pairs than that. ``more_than`` leaves out patterns without more extractions than that.
    A round that changes nothing ends it."""
    spark = counts.sparkSession
    most = rounds * per_round + at_least + 1 if rounds >= SOME else None
    tables = postings(counts if "found" in counts.columns else grouped(counts), seeds, mode, more_than=more_than, most=most, ordered=rounds >= MANY)
    state = store.kept(tables.hits())
    chosen: dict[str, tuple[float, int]] = {}
    pairs: list[tuple[str, str, float, int]] = []
    for k in range(1, rounds + 1):
        scored = _scored(state, digits)
        wanted = scored.where(~F.col("pattern").isin(*chosen)).orderBy(F.desc("score"), "pattern").limit(1)
        if chosen and not frozen:
            wanted = wanted.unionByName(scored.where(F.col("pattern").isin(*chosen)))
        got = {r["pattern"]: r["score"] for r in wanted.collect()}
        new = [p for p in got if p not in chosen]
        for p in new:
            chosen[p] = (got[p], k)
        if not chosen:
            break
        now = spark.createDataFrame([*({p: s for p, (s, _) in chosen.items()} | got).items()], "pattern string, score double")
        # as many rows as rounds and pairs allow
        known = spark.createDataFrame([p[:2] for p in pairs], "anaphor string, antecedent string")
        rows = tables.by_pattern.where(F.col("pattern").isin(*chosen)) if rounds >= MANY else tables.by_pattern
        open_pairs = rows.join(F.broadcast(now), "pattern")
        open_pairs = open_pairs.groupBy("anaphor", "antecedent").agg(F.round(F.sum(1 + 0.01 * F.col("score")), digits).alias("score")).join(F.broadcast(known), ["anaphor", "antecedent"], "left_anti")
        if at_least and open_pairs.limit(at_least + 1).count() <= at_least:
            if not new:
                break
            continue
        best = open_pairs.orderBy(F.desc("score"), "anaphor", "antecedent").limit(per_round).withColumns({"ka": _key("anaphor", mode), "kt": _key("antecedent", mode)}).collect()
        pairs += [(r["anaphor"], r["antecedent"], r["score"], k) for r in best]
        more = tables.more_hits([(r["ka"], r["kt"]) for r in best]) if k < rounds else None
        if more is not None:
            old, state = state, store.kept(state.unionByName(more).groupBy("pattern").agg(F.sum("hits").alias("hits"), F.max("total").alias("total")))
            store.drop(old)
        if not new and not best:
            break
    return Bootstrapped([(p, s, k) for p, (s, k) in chosen.items()], pairs)
