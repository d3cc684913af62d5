"""Edge cases of search, join and quality rules: clashing columns, empty tables, repeats, odd values, long texts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quillspark.llm import jaccard, mtree, quality
from quillspark.llm import textvec as V

TEXTS = [None, "", "one two", "#a *b $c %d &e |f <g >h\n\nx\nx \nx\n", "a b c d e f " * 9, "é 日本 # \t\x0b x", "same line here\n" * 30, " ".join(f"w{i}" for i in range(50)), "  not \x85 space"]


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    cover = {k + j for k in range(len(words) - 4) if c[tuple(words[k : k + 5])] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_quality_counts_and_verdicts(spark):
    docs = spark.createDataFrame([(i, t, 0.1, True) for i, t in enumerate(TEXTS)] + [(None, TEXTS[7], 0.1, True)], "doc_id long, text string, p_quality double, kept boolean")
    size = 2 * quality.HALF
    for shift, good in ((40.0, True), (-40.0, False), (float(np.log(quality.KEEP / (1 - quality.KEEP))), None)):
        model = quality.Regression(np.zeros(size, np.float32), 0.0, 1.0, shift)
        p = model.probability(np.zeros((1, size), np.float32))[0]
        for r in quality.judge(docs, model).collect():
            want = _brute(TEXTS[7 if r.doc_id is None else r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            assert r.kept == (not r.base_failed and (p >= quality.KEEP if good is None else good))
    assert quality.judge(docs.where("doc_id < 0"), model).collect() == []


def test_ngrams_are_of_characters():
    """Grams of two texts with the same characters in the same order are the same, whatever the bytes' length."""
    col = pa.array(["ab", "éa", "aé", "日本", "日", "ab"])
    (_, _, data, off), = V.chunks(col)
    x = quality.inputs(data, off)[:, : quality.HALF]
    assert (x > 0).sum(1).tolist() == [1, 1, 1, 1, 0, 1] and (x[0] == x[5]).all()


def test_calibration_without_own_labels():
    rng = np.random.default_rng(0)
    # inputs that tell nothing: a calibration on rows that were fitted would be sure of itself
    x, y = rng.normal(0, 1, (60, 2000)).astype(np.float32), (np.arange(60) % 2).astype(np.float32)
    p = quality.fit(x, y, 0.5).probability(rng.normal(0, 1, (500, 2000)).astype(np.float32))
    assert np.abs(p - 0.5).mean() < 0.15


def _top(x, ids, queries, k):
    return {q: sorted(((int(x[ids.index(q)] @ x[j]), -i) for j, i in enumerate(ids) if i != q), reverse=True)[:k] for q in queries}


def test_search_over_many_groups_is_exact(spark, monkeypatch):
    for name, v in (("PER_PIVOT", 30), ("PAGE", 16), ("NODE", 4), ("GROUP", 32), ("PART", 3)):
        monkeypatch.setattr(mtree, name, v)
    rng = np.random.default_rng(4)
    centre = rng.integers(-60, 60, (6, 5))
    x = np.concatenate([centre[rng.integers(0, 6, 350)] + rng.integers(-4, 5, (350, 5)), np.repeat(centre[:1], 80, 0), np.zeros((5, 5), int)])
    ids = rng.permutation(2000)[: len(x)].tolist()
    df = spark.createDataFrame([(int(i), [int(c) for c in r], "x", 1) for i, r in zip(ids, x)], "vec_id long, v array<long>, grp string, floor int")
    for k in (1, 5):
        got = {}
        for r in mtree.top_k(df, df.where("vec_id % 7 = 0"), k).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.score, -r.vec_id)
        want = _top(x, ids, [i for i in ids if i % 7 == 0], k)
        assert {q: [v[j] for j in sorted(v)] for q, v in got.items()} == want


def test_search_leaves_bad_vectors_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [1.0]), (6, [0.25, 0.25, 9.0]), (None, [5.0, 5.0]), (50, [-1.0, 1.0])]
    raw = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = raw.select("vec_id", mtree.whole(raw, "embedding").alias("v"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    x = {0: [256, 512, 0], 5: [256, 0, 0], 6: [64, 64, 2304], 50: [-256, 256, 0]}
    want = []
    for q in (0, 50):
        order = sorted((-int(np.dot(x[q], v)), i) for i, v in x.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted(got) == want
    assert mtree.top_k(df.where("vec_id < 0"), df, 5).collect() == [] == mtree.top_k(df, df.where("vec_id < 0"), 5).collect()


def test_join_with_clashing_columns_long_texts_and_nothing(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "x " * 4000), (4, "x"), (5, "x x"), (6, "one two three four"), (7, "ONE, two! three four"), (None, "x"), (8, "...")]
    docs = spark.createDataFrame([(*r, 1, "s", 5) for r in rows], "doc_id long, text string, rep int, bands string, n int")
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard.join(docs).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 2, 1), 3: (3, 3, 0), 4: (4, 4, 0), 5: (5, 5, 0), 6: (6, 6, 1), 7: (6, 6, 1), 8: (8, 8, 0), None: (None, None, 0)}
    assert jaccard.join(docs.where("doc_id < 0")).collect() == []


def test_join_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"own{i}", *base[i % 60 + 1 :]])) for i in range(90)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    links = {i: sum(j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = {r.doc_id: r.n_links for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == links and max(links.values()) > 10
