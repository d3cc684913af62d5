"""Command line: ``score`` links against gold, ``coverage`` of gold pairs by a word-pair resource, ``bootstrap`` pairs from
tagged text, ``coref`` of CoNLL files, ``resolve`` bridging links by a classifier of pairs, ``anaphors`` alone by a classifier of mentions."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark import session, store
from quillspark.functions import columns as C
from quillspark.operators import anaphoricity, bootstrapping, context, coreference, evaluation, learning, patterns, resolver, resources, trees
from quillspark.sources import readers, writers


#: Word lists of the recogniser.
WORDS = (*anaphoricity.LISTS, "countries", *context.CLASSES)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    for name, places in {"score": ("gold", "system"), "coverage": ("gold", "resource"), "bootstrap": ("corpus", "seeds", "out"), "coref": ("corpus", "out"), "resolve": ("corpus", "markables", "resource", "out"), "anaphors": ("corpus", "markables", "out")}.items():
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place)
        if name == "bootstrap":
            p.add_argument("--rounds", type=int, default=200)
            p.add_argument("--per-round", type=int, default=10)
        if name == "coref":
            p.add_argument("--demonyms")
        if name == "resolve":
            p.add_argument("--folds", type=int, default=10)
            p.add_argument("--window", type=int, default=1)
            p.add_argument("--terms", type=int, default=15, help="terms of a document that count as its best by tf-idf")
            p.add_argument("--general", help="words and their synsets, tab-separated")
            p.add_argument("--general-pairs", help="pairs of synsets, tab-separated; needs --general")
            p.add_argument("--net", help="data files of a lexical net")
            p.add_argument("--kernel", choices=learning.KERNELS, default=learning.PAIRS.kernel)
        if name == "anaphors":
            p.add_argument("--folds", type=int, default=10)
            p.add_argument("--ratios", help="JSON of argument ratios")
            for words in WORDS:
                p.add_argument(f"--{words.replace('_', '-')}", help="word list")
    return top


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = session.ship(SparkSession.builder.getOrCreate())
    if a.what == "score":
        print(writers.report(evaluation.score_links(readers.links(spark, a.gold), readers.links(spark, a.system))).first().report)
    elif a.what == "coverage":
        r = resources.coverage(readers.gold_pairs(spark, a.gold), readers.word_pairs(spark, a.resource).select("anaphor", F.explode("antecedents").alias("antecedent"))).first()
        print("\n".join(f"{k} {r[k + '_found']}/{r[k + '_gold']} {r[k + '_coverage']:.4f}" for k in ("anaphor", "antecedent", "pair")))
    elif a.what == "bootstrap":
        counted = patterns.prune(patterns.count_extractions(patterns.extract(readers.tagged(spark, a.corpus))))
        writers.bootstrapped(bootstrapping.bootstrap(counted, readers.seeds(spark, a.seeds), rounds=a.rounds, per_round=a.per_round), spark, a.out)
    elif a.what == "resolve":
        words = store.kept(trees.keyed(readers.conll(spark, a.corpus)))
        found = store.kept(trees.align(trees.mentions(words), readers.markables(spark, a.markables), words))
        gold = trees.gold_links(found).select("doc", F.col("anaphor_ment").alias("anaphor"), F.col("antecedent_ment").alias("antecedent"))
        lexicon = readers.word_pairs(spark, a.resource).select("anaphor", F.explode("antecedents").alias("antecedent"))
        folds = found.select("doc").distinct().withColumn("fold", F.pmod(F.xxhash64("doc"), F.lit(a.folds)).cast("int"))
        more = {"top_terms": resolver.corpus_terms(words, a.terms), "settings": dataclasses.replace(learning.PAIRS, kernel=a.kernel)}
        if a.general and a.general_pairs:
            more |= {"general": readers.seeds(spark, a.general).toDF("word", "synset"), "general_pairs": readers.seeds(spark, a.general_pairs)}
        if a.net:
            more["net"] = resolver.net_of_heads(found, *(store.kept(t) for t in readers.lexical_net(spark, a.net)))
        links = resolver.resolve(found, gold, lexicon, folds, window=a.window, **more)
        for side in ("anaphor", "antecedent"):
            facts = found.select("doc", F.col("ment").alias(side), F.col("markable").alias(f"{side}_id"), C.spoken(F.col("tokens")).alias(f"{side}_text"))
            links = links.join(facts, ["doc", side]).drop(side).withColumnRenamed(f"{side}_id", side)
        writers.system_lines(links).write.text(a.out)
    elif a.what == "anaphors":
        words = store.kept(trees.keyed(readers.conll(spark, a.corpus)))
        found = store.kept(trees.align(trees.mentions(words), readers.markables(spark, a.markables), words))
        lists = {w: readers.word_list(spark, path, lower=w not in ("wordnet_relational", "countries")) for w in WORDS if (path := getattr(a, w))}
        tables = anaphoricity.Tables(trees.sentences(words), lists, readers.json_map(spark, a.ratios) if a.ratios else None)
        folds = found.select("doc").distinct().withColumn("fold", F.pmod(F.xxhash64("doc"), F.lit(a.folds)).cast("int"))
        got = store.kept(anaphoricity.recognise(found.withColumn("label", anaphoricity.is_anaphor(F.col("antecedents"))), tables, folds))
        writers.system_lines(anaphoricity.self_links(got, found)).write.text(a.out)
        r = learning.accuracy(got).first()
        print(f"mentions {r['rows']} correct {r['correct']} precision {r['precision']:.4f} recall {r['recall']:.4f}")
    else:
        words = trees.keyed(readers.conll(spark, a.corpus))
        found = trees.mentions(words)
        places = {r.place: r.demonym for r in readers.demonyms(spark, a.demonyms).collect()} if a.demonyms else None
        writers.conll(trees.with_clusters(words, found, coreference.resolve(found, demonyms=places)), a.out)


if __name__ == "__main__":
    main()
