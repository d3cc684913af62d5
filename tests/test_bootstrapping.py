"""Incremental bootstrapping against a recount of everything in every round."""

import math
import random
from collections import defaultdict

import pytest

from quillspark.operators import bootstrapping


def _head(w):
    return w.rsplit("_", 1)[-1]


def recount(counts, seeds, rounds, per_round, mode, frozen, at_least, digits):
    lexicon = {(_head(a), _head(t)) for a, t in seeds}
    chosen, pairs = {}, []
    for k in range(1, rounds + 1):
        if mode == "strict":
            keys = {(_head(a), _head(t)) for a, t in lexicon}
            hit = lambda a, t: (_head(a), _head(t)) in keys  # noqa: B023, E731
        else:
            one, two = ({_head(x[i]).lower() for x in lexicon} for i in (0, 1))
            hit = lambda a, t: _head(a).lower() in one and _head(t).lower() in two  # noqa: B023, E731
        hits, total = defaultdict(int), defaultdict(int)
        for (p, a, t), n in counts.items():
            total[p] += n
            hits[p] += n * hit(a, t)
        score = {p: round(h / total[p] * math.log(h), digits) for p, h in hits.items() if h and round(h / total[p] * math.log(h), digits) > 0}
        now = {p: score.get(p, s) if not frozen else s for p, (s, _) in chosen.items()}
        new = sorted((-s, p) for p, s in score.items() if p not in chosen)[:1]
        for s, p in new:
            chosen[p], now[p] = (-s, k), -s
        if not now:
            break
        scored = defaultdict(float)
        for p, a, t in counts:
            if p in now and (a, t) not in lexicon:
                scored[a, t] += 1 + 0.01 * now[p]
        if at_least and len(scored) <= at_least:
            continue
        for s, (a, t) in sorted((-round(s, digits), x) for x, s in scored.items())[:per_round]:
            lexicon.add((a, t))
            pairs.append((a, t, -s, k))
    return [(p, s, k) for p, (s, k) in chosen.items()], pairs


@pytest.mark.parametrize(("mode", "frozen", "at_least"), [("strict", False, 0), ("strict", True, 0), ("relaxed", False, 0), ("strict", False, 4)])
def test_rounds_equal_a_recount(spark, mode, frozen, at_least):
    rng = random.Random(11)
    words = ["roof", "old_roof", "Door", "door", "house", "big_house", "car", "wheel", "Roof", "engine"]
    counts = defaultdict(int)
    for _ in range(260):
        counts[f"<Y> p{rng.randint(0, 14)} <X>", rng.choice(words), rng.choice(words)] += rng.randint(1, 4)
    seeds = [("old_roof", "house"), ("door", "car"), ("wheel", "car")]
    rows = spark.createDataFrame([(*k, n) for k, n in counts.items()], "pattern string, anaphor string, antecedent string, cnt long")
    got = bootstrapping.bootstrap(rows, spark.createDataFrame(seeds, "anaphor string, antecedent string"), rounds=20, per_round=3, mode=mode, frozen=frozen, at_least=at_least, digits=9)
    patterns, pairs = recount(counts, seeds, 20, 3, mode, frozen, at_least, 9)
    near = lambda rows: [tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in rows]
    assert near(got.patterns) == near(patterns) and near(got.pairs) == near(pairs) and len(pairs) > 30


def test_jobs_of_a_round_are_constant(spark):
    counts = spark.createDataFrame([(f"<Y> p{p} <X>", f"a{(p * 3 + i) % 40}", f"t{(p * 3 + i) % 40}", 2) for p in range(30) for i in range(6)], "pattern string, anaphor string, antecedent string, cnt long")
    seeds = counts.select("anaphor", "antecedent").limit(2)
    jobs = []
    for rounds in (2, 5, 8):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        got = bootstrapping.bootstrap(counts, seeds, rounds=rounds, per_round=1)
        assert len(got.patterns) == rounds
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs((jobs[2] - jobs[1]) - (jobs[1] - jobs[0])) <= 3


def test_nothing_to_grow_from(spark):
    none = spark.createDataFrame([], "pattern string, anaphor string, antecedent string, cnt long")
    assert bootstrapping.bootstrap(none, none.select("anaphor", "antecedent"), rounds=3) == bootstrapping.Bootstrapped([], [])


@pytest.mark.parametrize("first", [1000, 3])
def test_rounds_score_no_more_pairs_of_a_class_than_they_can_add(spark, monkeypatch, first):
    """Ten times the pairs that the same patterns extract are no more to score; before, each round scored all of them."""
    made = []
    monkeypatch.setattr(bootstrapping, "FIRST", first, raising=False)
    monkeypatch.setattr(bootstrapping, "postings", (lambda f: lambda *a, **k: made.append(f(*a, **k)) or made[-1])(bootstrapping.postings))
    for n in (300, 3000):
        counts = {(p, f"a{i * 7 % n:04}", "t"): 2 for p, each in (("<Y> of <X>", 1), ("<Y> in <X>", 5), ("<X> for <Y>", 3)) for i in range(0, n, each)}
        rows = spark.createDataFrame([(*k, c) for k, c in counts.items()], "pattern string, anaphor string, antecedent string, cnt long")
        seeds = [("a0000", "t"), ("a0003", "t")]
        got = bootstrapping.bootstrap(rows, spark.createDataFrame(seeds, "anaphor string, antecedent string"), rounds=5, per_round=3, digits=9)
        patterns, pairs = recount(counts, seeds, 5, 3, "strict", False, 0, 9)
        assert [(a, t, k) for a, t, _, k in got.pairs] == [(a, t, k) for a, t, _, k in pairs] and [p for p, *_ in got.patterns] == [p for p, *_ in patterns]
    small, large = (m.by_pattern.count() for m in made)
    assert small == large < 4 * 16 * 3
