"""The URL filter against the same method written for plain Python lists."""

import math
import random
import re
from collections import Counter, defaultdict

from quillspark.llm import queries, url_filter as U


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def _brute(pages):
    rows = []
    for page, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        shaped = tuple(("*" + re.search(r"(\.[a-z]+)?$", s)[0]) if re.match(U.VARIABLE, s.lower()) else "\\" + s if s[0] in "*+\\" else s for s in path.split("/") if s)
        rows.append((page, host, path, *_rule(host, path), shaped))
    urls = {(r[1], r[2]): (r[4], r[5]) for r in rows}
    leaf = defaultdict(list)
    for (host, _), (verdict, shaped) in urls.items():
        leaf[host, shaped].append(verdict)
    tree = {k: k[1] for k in leaf}
    for k in range(max((len(t) for t in tree.values()), default=0)):
        kinds = defaultdict(Counter)
        for (host, shaped), t in tree.items():
            if len(t) > k:
                kinds[host, t[:k]][t[k]] += len(leaf[host, shaped])
        rare = {a: {s for s, n in c.items() if n * U.CHILDREN <= sum(c.values())} for a, c in kinds.items()}
        for key, t in tree.items():
            found = rare.get((key[0], t[:k]), ())
            if len(t) > k and len(found) >= U.CHILDREN and t[k] in found:
                tree[key] = (*t[:k], "*", *t[k + 1 :])
    ruled = defaultdict(list)
    for key, t in tree.items():
        ruled[key[0], t] += [v for v in leaf[key] if v]
    node, fixed = {k: k[1] for k in ruled}, dict.fromkeys(ruled, False)
    for d in range(max((len(t) for t in node.values()), default=0), 0, -1):
        family = defaultdict(lambda: defaultdict(list))
        for key, n in node.items():
            if not fixed[key] and len(n) == d:
                family[key[0], n[:-1]][n] += ruled[key]
        apart = {(key[0], n[: d - 1]) for key, n in node.items() if fixed[key] and len(n) >= d}
        change = {}
        for (host, above), own in family.items():
            every = [v for vs in own.values() for v in vs]
            same = {}
            for n, vs in own.items():
                b, m, b_all, m_all = vs.count("block"), len(vs), every.count("block"), len(every)
                if len(own) == 1:
                    same[n] = True
                elif min(m, m_all - m) < U.LEAST:
                    same[n] = False
                elif b_all in (0, m_all):
                    same[n] = True
                else:
                    p = b_all / m_all
                    z = (b / m - (b_all - b) / (m_all - m)) / math.sqrt(p * (1 - p) * (1 / m + 1 / (m_all - m)))
                    same[n] = z * z <= U.ALIKE
            up = all(same.values()) and (host, above) not in apart
            for n in own:
                change[host, n] = (above, False) if up else ((*above, "+") if same[n] else n, True)
        for key, n in node.items():
            if not fixed[key] and (key[0], n) in change and len(n) == d:
                node[key], fixed[key] = change[key[0], n]
    every = [v for vs in ruled.values() for v in vs]
    prior = every.count("block") / len(every) if every else 0.0
    branch, members = defaultdict(list), Counter()
    for key, n in node.items():
        branch[key[0], n] += ruled[key]
        members[key[0], n] += 1
    out = []
    for page, host, path, rule, verdict, shaped in rows:
        n = node[host, tree[host, shaped]]
        vs = branch[host, n]
        purity = (vs.count("block") + U.WEIGHT * prior) / (len(vs) + U.WEIGHT)
        out.append((page, host, path, rule, verdict or ("block" if purity >= U.REJECT else "allow"), "/" + "/".join(n), round(purity, 9), members[host, n]))
    return Counter(out)


def _got(spark, pages):
    rows = U.judge(spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id long, url string, s0 string, n int"), queries.RULES)
    return Counter((*r[:6], round(r[6], 9), r[7]) for r in rows.collect())


def test_judge_is_brute_force(spark):
    rng = random.Random(3)
    hosts = ["A.example.net", "example.com", "x.org", "plain.io", "notexample.com"]
    words = ["en", "de", "fr", "news", "12", "2024-05-01", "deadbeef01", "77.html", "a b"]
    urls = [f"http://{rng.choice(hosts)}/{'/'.join(rng.choice([*words, f'slug-{rng.randrange(400)}']) for _ in range(rng.randrange(5)))}" + rng.choice(["", "?q=/x", "#f"]) for _ in range(600)]
    urls += [None, "", "no scheme/de/", "://", "http://EXAMPLE.com", "https://example.com?x", "http://example.net/en/a", "http://org/fr/", "x://é.ÉU/Ü", *["http://one.net/a"] * 3]
    pages = list(enumerate(urls)) + [(0, urls[0]), (None, "http://b.net/q")]
    assert _got(spark, pages) == _brute(pages)


def test_repeated_rows_change_nothing(spark):
    urls = [f"http://a.example.net/user/u{i}/{'spam' if i % 3 else 'en'}/{i}/deep/{i % 2}" for i in range(40)]
    once = _got(spark, list(enumerate(urls)))
    assert once == _brute(list(enumerate(urls)))
    again = _got(spark, [*enumerate(urls), *((100 + i, urls[0]) for i in range(200))])
    assert {r[:8] for r in once} == {r[:8] for r in again if r[0] < 100}


def test_rates_are_compared_with_their_counts():
    import duckdb

    # 26 of 100 against 24 of 100 is alike, 1 of 5 against 3 of 5 too, 10 of 100 against 60 of 100 is not, nor are fewer than five
    rows = [(26, 100, 50, 200, True), (1, 5, 4, 10, True), (10, 100, 70, 200, False), (0, 0, 5, 9, False), (1, 4, 4, 8, False)]
    for b, n, b_all, n_all, want in rows:
        q = "select l >= 5 and l_all - l >= 5 and power(b * (l_all - l) - (b_all - b) * l, 2) * l_all <= 3.84 * l * (l_all - l) * b_all * (l_all - b_all) from (select ?::double b, ?::double l, ?::double b_all, ?::double l_all)"
        assert duckdb.execute(q, [b, n, b_all, n_all]).fetchone()[0] is want


def test_labels_of_one_branch_do_not_speak_for_others(spark):
    """A host labelled below /de/ only: its other pages are as the rate of all has them, however many there are."""
    urls = [f"http://m.example.com/de/{k}x" for k in range(9)] + [f"http://m.example.com/{w}/{k}x" for w in ("shop", "news") for k in range(40)] + ["http://m.example.com/"] * 30
    urls += [f"http://other.org/fr/p{k}" for k in range(20)]
    got = _got(spark, list(enumerate(urls)))
    assert got == _brute(list(enumerate(urls)))
    assert {r[4] for r in got if r[1] == "m.example.com" and not r[2].startswith("/de/")} == {"allow"}


def test_literal_marks_are_no_wildcards(spark):
    urls = ["http://a.io/x/*", "http://a.io/x/17", "http://a.io/+/b", "http://a.io/x/\\*", "http://a.io/x/*.html", "http://a.io/x/3.html"]
    got = _got(spark, list(enumerate(urls)))
    assert got == _brute(list(enumerate(urls))) and len({r[5] for r in got}) == 6


def test_one_deep_url_adds_no_levels(spark):
    import time

    urls = [f"http://a.example.net/{w}/{k}" for w in ("en", "x") for k in range(30)] + ["http://a.example.net/" + "/".join(f"s{k}" for k in range(2000)), "http://b.io/" + "y/" * 3000]
    began = time.time()
    got = _got(spark, list(enumerate(urls)))
    assert len(got) == 62 and time.time() - began < 60
    short = [u if len(u) < 99 else u[:60] for u in urls]
    assert {r[:5] for r in got if len(r[2]) < 40} == {r[:5] for r in _brute(list(enumerate(short))) if len(r[2]) < 40}


def test_without_labels_or_rows(spark):
    pages = [(1, "http://plain.io/a"), (2, None)]
    assert _got(spark, pages) == _brute(pages)
    assert {r[4] for r in _got(spark, pages)} == {"allow"}
    assert not _got(spark, pages[:0])
