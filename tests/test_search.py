"""Backward search and mentions between, on random documents with nested mentions, against loops over all mentions."""

import hashlib
import random
from collections import Counter

import pytest

from quillspark.operators import mentions as M

SCHEMA = "doc long, ment string, sent int, start int, end int, ord int, tokens array<string>, head string"
WORDS = ["roof", "house", "door", "old", "car", "wheel", "it"]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(8), []
    for doc in range(6):
        for sent in range(5):
            spans = {(a, a + rng.randint(0, 3)) for a in (rng.randint(0, 14) for _ in range(rng.randint(0, 6)))}
            for k, (a, b) in enumerate(rng.sample(sorted(spans), len(spans))):
                toks = rng.choices(WORDS, k=b - a + 1)
                out.append((doc, f"{sent}:{k}", sent, a, b, k, toks, toks[-1]))
    return out


LEXICON = [("roof", "house"), ("door", "house"), ("door", "car"), ("wheel", "car"), ("old", "roof"), ("house", "house"), ("it", None)]


def search(rows, min_sent):
    out = set()
    for doc, ment, sent, start, *_, toks, _ in rows:
        key = next((t for t in toks if t in {a for a, _ in LEXICON}), None)
        wanted = {t for a, t in LEXICON if a == key and t}
        found = [(-s, o, m) for d, m, s, _, e, o, w, _ in rows if d == doc and wanted & set(w) and ((s == sent and e < start) or min_sent <= s < sent)]
        if found:
            out.add((doc, ment, min(found)[2]))
    return out


def listed(rows, doc, a, t):
    by = {r[1]: r for r in rows if r[0] == doc}
    (_, _, s1, ab, *_), (_, _, s0, _, te, *_) = by[a], by[t]
    inside = [(s, b, m) for d, m, s, b, e, *_ in rows if d == doc and m not in (a, t) and s0 <= s <= s1 and (s > s0 or b > te) and (s < s1 or e < ab)]
    return [m for *_, m in sorted(inside)]


def test_backward_search(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    lexicon = spark.createDataFrame(LEXICON, "anaphor string, antecedent string")
    for min_sent in (0, 1, 3):
        got = [tuple(r) for r in M.backward_search(df, lexicon, min_sent=min_sent).select("doc", "anaphor", "antecedent").collect()]
        assert set(got) == search(rows, min_sent) and len(got) == len(set(got))
    assert M.backward_search(df.limit(0), lexicon).count() == 0


def test_between_and_negatives(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    links = sorted({(r[0], r[1], t[1]) for r in rows for t in rows if r[0] == t[0] and (t[2], t[4]) < (r[2], r[3]) and (t[2] < r[2] or t[4] < r[3])})
    links = random.Random(1).sample(links, 200)
    pairs = spark.createDataFrame(links, "doc long, anaphor string, antecedent string")
    got = {(r.doc, r.anaphor, r.antecedent): r for r in M.between(pairs, df).collect()}
    want, negative = {}, Counter()
    for key in links:
        b = want[key] = listed(rows, *key)
        n = len(b)
        if n >= 4:
            drawn = []
            for j in range(4):
                x = int(hashlib.md5("|".join([*map(str, key), str(j)]).encode()).hexdigest()[:8], 16) % (n - j)
                for c in sorted(drawn):
                    x += x >= c
                drawn.append(x)
            assert len(set(drawn)) == 4
            negative.update([(key[0], b[drawn[0]], b[drawn[1]]), (key[0], b[drawn[2]], b[drawn[3]])])
        else:
            negative.update({0: [], 1: [(key[0], key[1], *b[:1])], 2: [(key[0], *b[1:2], *b[:1])], 3: [(key[0], *b[:1], key[2]), (key[0], *b[2:3], *b[1:2])]}[n])
    assert {k: r.n_between for k, r in got.items()} == {k: len(b) for k, b in want.items()} and max(map(len, want.values())) > 8
    assert Counter(map(tuple, M.negatives(pairs, df).select("doc", "anaphor", "antecedent").collect())) == negative


def test_one_long_document(spark):
    """20,000 mentions with two words: a row for each lookup and for each occurrence, not for each pair of them."""
    df = spark.range(20_000).selectExpr("cast(1 as long) as doc", "cast(id as string) as ment", "cast(id div 4 as int) as sent", "cast(id % 4 * 2 as int) as start", "cast(id % 4 * 2 as int) as end", "cast(id % 4 as int) as ord", "array(if(id % 2 = 0, 'roof', 'house')) as tokens", "if(id % 2 = 0, 'roof', 'house') as head")
    lexicon = spark.createDataFrame([("roof", "house")], "anaphor string, antecedent string")
    got = {int(r.anaphor): int(r.antecedent) for r in M.backward_search(df, lexicon, min_sent=0).collect()}
    assert len(got) == 9999 and got[6] == 5 and got[8] == 5 and got[19_998] == 19_997


def test_backward_search_far_and_near(spark, rows, monkeypatch):
    """Lookups further back than the tested sentences, and a key with very many antecedents: no lookup that finds one nearby meets all of them."""
    df = spark.createDataFrame(rows, SCHEMA)
    lexicon = spark.createDataFrame(LEXICON, "anaphor string, antecedent string")
    got = [tuple(r) for r in M.backward_search(df, lexicon, near=2).collect()]
    assert set(got) == search(rows, 1) and len(got) == len(set(got))
    words = [(1, str(k), k // 2, k % 2 * 2, k % 2 * 2, k % 2, ["roof" if k == 41 else "yard"]) for k in range(42)]
    df = spark.createDataFrame([*words, (1, "last", 40, 0, 0, 0, ["house"])], "doc long, ment string, sent int, start int, end int, ord int, tokens array<string>")
    far = spark.createDataFrame([("house", "roof"), ("house", "none")], "anaphor string, antecedent string")
    assert [tuple(r) for r in M.backward_search(df, far).collect()] == [(1, "last", "41")]
    many = spark.range(4_000).selectExpr("cast(id div 40 as long) as doc", "cast(id as string) as ment", "cast(id % 40 + 1 as int) as sent", "0 as start", "0 as end", "0 as ord", "array('w0') as tokens")
    wide = spark.range(20_000).selectExpr("'w0' as anaphor", "concat('w', id) as antecedent")
    asked = []
    monkeypatch.setattr(M, "_far", lambda left, *rest, far=M._far: (asked.append(left.count()), far(left, *rest))[1])
    # one row for each antecedent of each lookup would be 80 million
    assert M.backward_search(many, wide).count() == 4_000 - 100 and not asked



def test_between_sends_no_lists(spark, rows):
    """Pairs meet the list of a sentence in the last join only, for the anaphor's sentence; before, also for the antecedent's, and the lists went through the next shuffle."""
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = spark.createDataFrame([(1, "a", "b")], "doc long, anaphor string, antecedent string")
    plan = M.between(pairs, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3
