"""What the cost of queries of annotated documents rests on: shuffles, Python workers, rows held at once."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import coreference
from quillspark.plans import queries


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("talk")), random.Random(2)
    words = ["old", "red", "house", "roof", "the", "of", "he", "Peru", "door", ","]
    spark.createDataFrame([(k // 5, k % 5, "u", " ".join(rng.choices(words, k=rng.randint(0, 15)))) for k in range(200)], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["coref_pass_exact", "cluster_column", "coref_column_spans", "gold_chains"])
def test_equal_texts_take_one_shuffle_and_no_python(spark, talk, name):
    p = plan(queries.QUERIES[name](spark, talk))
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange" not in p.replace("Exchange hashpartitioning", "") and "Python" not in p and "Pandas" not in p and "Arrow" not in p


def test_exact_clusters_equal_the_passes_over_documents(spark, talk):
    m = queries.talk(spark, talk).withColumns({"l2r": F.expr("pmod(hash(ment), 7)"), "r2l": F.expr("pmod(hash(ment, 1), 5)")})
    slow = coreference.resolve(m, [lambda p: coreference.exact(p)])
    fast = coreference.resolve(m, ["exact"])
    assert fast.dtypes == slow.dtypes
    rows = [sorted(map(tuple, df.collect()), key=str) for df in (fast, slow)]
    assert rows[0] == rows[1] and any(r[2] for r in rows[0])


@pytest.mark.parametrize("size", [1, 7, 10000])
def test_documents_across_batches(spark, talk, size):
    """Documents are told apart in a stream of rows, wherever batches end, and no group of rows is set up for each of them."""
    m = queries.talk(spark, talk).repartition(2)
    want = sorted(map(tuple, coreference.resolve(m).collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        df = coreference.resolve(m)
        got = sorted(map(tuple, df.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len({r[0] for r in got}) == 40 and "FlatMapGroups" not in plan(df)
    by = {}
    for doc, ment, cluster, _ in got:
        if cluster is not None:
            by.setdefault((doc, cluster), []).append(ment)
    assert by and all(len(v) > 1 for v in by.values())


@pytest.mark.parametrize("name", ["constituents", "phrase_heads"])
def test_brackets_of_sentences_take_no_shuffle_and_no_sort(spark, talk, name):
    p = plan(queries.QUERIES[name](spark, talk))
    assert "Exchange" not in p and "Sort" not in p and "Window" not in p


def _by_stack(words: list[tuple]) -> set[tuple]:
    """node, parent, label, start, end, head of a sentence without faults, with a stack."""
    nodes, open_, done = [], [], []
    for k, (token, tag, bits) in enumerate(words):
        for mark in bits.replace("(", " (").replace("*", " * ").replace(")", " ) ").split():
            if mark == ")":
                nodes[open_.pop()][3] = k
                continue
            nodes.append([open_[-1] if open_ else None, mark[1:] or tag, k, k, mark == "*"])
            if mark != "*":
                open_.append(len(nodes) - 1)

    def head(n: int) -> str:
        kids = [k for k, x in enumerate(nodes) if x[0] == n]
        if nouns := [k for k in kids if nodes[k][4] and nodes[k][1] == "NN"]:
            return words[nodes[nouns[-1]][2]][0]
        if phrases := [k for k in kids if not nodes[k][4] and nodes[k][1] == "NP"]:
            return head(phrases[-1])
        inside = words[nodes[n][2] : nodes[n][3] + 1]
        return ([t for t, tag, _ in inside if tag == "NN"] or [inside[-1][0]])[-1]

    for n, (parent, label, start, end, _) in enumerate(nodes):
        done.append((n + 1, None if parent is None else parent + 1, label, start, end, head(n)))
    return set(done)


@pytest.mark.parametrize("words", [3, 1 << 15])
def test_nodes_equal_a_stack(spark, monkeypatch, words):
    from quillspark.operators import brackets

    monkeypatch.setattr(brackets, "WORDS", words)
    rng, sentences = random.Random(6), []
    for _ in range(60):
        depth, sentence = 0, []
        n = rng.randint(1, 9)
        for k in range(n):
            opened = rng.randint(0, 3) + (k == 0)
            closed = depth + opened if k == n - 1 else rng.randint(0, max(0, depth + opened - 1))
            depth += opened - closed
            sentence.append((f"w{k}", rng.choice(["NN", "DT"]), "".join(rng.choice(["(NP", "(VP"]) for _ in range(opened)) + "*" + ")" * closed))
        sentences.append(sentence)
    rows = [(k, 0, list(range(len(s))), *(list(x) for x in zip(*s, strict=True))) for k, s in enumerate(sentences)]
    df = spark.createDataFrame(rows, "doc long, sent int, places array<int>, tokens array<string>, tags array<string>, bits array<string>").coalesce(1)
    got = {}
    for b in brackets._run(iter(df.toArrow().to_batches())):
        for r in b.to_pylist():
            got.setdefault(r["doc"], set()).add((r["node"], r["parent"], r["label"], r["start"], r["end"], r["head"]))
    assert got == {k: _by_stack(s) for k, s in enumerate(sentences)}
    assert brackets.nodes(df).count() == sum(map(len, got.values())) and brackets.nodes(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def prose(spark, tmp_path_factory):
    d, rng = str(tmp_path_factory.mktemp("prose")), random.Random(5)
    words = ["roof", "house", "door", "car", "of", "the", "in", "wheel", ",", "engine"]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(6)) for _ in range(60)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def _oracle(d: str, name: str) -> list[tuple]:
    import duckdb

    from quillspark.plans import oracles

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    return sorted(con.execute(oracles.ORACLE[name]).fetchall())


def test_pattern_totals_need_no_counts_of_triples(spark, prose):
    df = queries.pattern_prune(spark, prose)
    p = plan(df)
    assert p.count("Exchange") == 1 and "Join" not in p
    assert sorted(map(tuple, df.collect())) == _oracle(prose, "pattern_prune")


def test_scores_of_pairs_shuffle_what_the_selected_patterns_extract(spark, prose):
    from quillspark.operators import patterns

    counts = queries.counted(spark, prose)
    good = patterns.prune(counts, few=True)
    out = patterns.score_pairs(good, spark.createDataFrame([("<Y> of <X>", 0.5)], "pattern string, score double"))
    top = plan(out).split("BroadcastHashJoin")[0]
    assert top.count("Exchange") == 2 and "SortMergeJoin" not in plan(out)
    assert sorted(map(tuple, queries.extraction_scores(spark, prose).collect())) == _oracle(prose, "extraction_scores")


@pytest.mark.parametrize("many", [1, 99])
def test_few_rounds_write_one_table_and_give_the_same(spark, prose, monkeypatch, many):
    from quillspark.operators import bootstrapping

    monkeypatch.setattr(bootstrapping, "MANY", many)
    monkeypatch.setattr(bootstrapping, "_ordered", (lambda f: lambda *a: made.append(a[2:]) or f(*a))(bootstrapping._ordered))
    made: list = []
    for name in ("bootstrap_round2", "bootstrap_frozen"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, prose).collect())) == _oracle(prose, name)
    assert len(made) == (4 if many == 1 else 0)


def test_terms_are_shuffled_once_as_texts(spark, prose):
    df = queries.tfidf_top15(spark, prose)
    assert plan(df).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(df)
    assert sorted(map(tuple, df.collect())) == _oracle(prose, "tfidf_top15")


def test_large_vocabularies_are_joined(spark, prose):
    from quillspark.operators import resources

    counts = resources.term_counts(queries.tokens(spark, prose).select("doc_id", "token"))
    a, b = (sorted(map(tuple, resources.tf_idf(counts, vocabulary=n).select("doc_id", "token", "cnt", "df", "score").collect())) for n in (0, 1 << 18))
    assert a == b and len(a) > 100
    assert resources.tf_idf(counts.limit(0)).count() == 0


def test_kept_mentions_are_not_written_again(spark, talk):
    from quillspark import store
    from quillspark.operators import anaphoricity

    m, tables = queries._tagged_talk(spark, talk)
    before = len(store._made)
    anaphoricity.assemble(m, tables)
    assert len(store._made) == before
