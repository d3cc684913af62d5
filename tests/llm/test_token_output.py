"""Token ids against the untouched libraries: counts after edits, packing, token files."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from quillspark.llm import packing, token_counts, token_files

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "a b", "a b", "Ünï 日本語 <|endoftext|> x", "word " * 3000, "x" * 5000, "1a2b!c'd 's" * 400, "the end.\n" * 700]
SCHEMA = "doc_id long, text string, ids string, length string, part int, rank string, ord string"


def _docs(spark):
    rows = [(i, t, "x", "y", 1, "z", "w") for i, t in enumerate(TEXTS)] + [(None, "no id", "", "", 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_is_brute_force(spark):
    path = P.path("byte_bpe_50k.json")
    tok, want = Tokenizer.from_file(path), {}
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k] = (a, b - a, _crc(ids[a:b]))
    rows = packing.pack(_docs(spark), path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert sum(r.length > 1024 for r in rows) == 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert packing.pack(_docs(spark).where("doc_id < 0"), path).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_never_more_sequences_than_best_fit(sf):
    """Lengths are guessed from characters here; only the histogram's form matters."""
    import duckdb

    n = duckdb.execute(f"select n_chars // 3 + 1 from '/root/testdata/sf{sf}/documents.parquet'").fetchnumpy()
    size = np.asarray(next(iter(n.values())), np.int64)
    count = np.bincount((size - 1) % 1024 + 1, minlength=1025)
    count[1024] += ((size - 1) // 1024).sum()
    made, report = packing.rounded(count, 1024)
    assert report["bound"] <= sum(m for _, m in made) <= report["best_fit"]
    assert sum(m for _, m in packing.best_fit(count, 1024)) == report["best_fit"]
    got = np.zeros(1025, np.int64)
    for items, m in made:
        assert sum(items) <= 1024
        np.add.at(got, items, m)
    assert (got == count).all()


def test_solution_beats_greedy_where_greedy_fails():
    # best fit puts the long pieces with the middle ones and wastes the rest: 6 a third, 6 a half less
    count = np.zeros(101, np.int64)
    for length, n in ((51, 600), (27, 600), (26, 600), (23, 1200)):
        count[length] = n
    made, report = packing.rounded(count, 100)
    assert report["bound"] == 900 and sum(m for _, m in made) == 900 < report["best_fit"]
    uses, bound = packing.solve(count, 100)
    covered = np.zeros(101)
    for config, times in uses:
        assert sum(x * a for x, a in config.items()) <= 100 and times > 0
        for x, a in config.items():
            covered[x] += a * times
    assert (covered <= count + 1e-6).all() and bound <= 900 + 1e-6


@pytest.mark.parametrize(("need", "optimum", "least"), [
    ({600: 1000, 500: 1000}, 1500, 1490),
    ({600: 1000, 300: 1500, 250: 500}, 1291.7, 1280),
    ({700: 500, 400: 900, 330: 700, 350: 10, 200: 100}, 1187, 1175),
    ({513: 400, 512: 400}, 600, 596),
    ({342: 300, 341: 300}, 225, 223),
    ({1: 1}, 1, 1 / 1024),
])
def test_bound_is_near_the_optimum_where_lengths_are_no_weights(need, optimum, least):
    """Lengths that cannot fill a sequence: the volume bound is far off, and weights have to move to find a better one."""
    count = np.zeros(1025, np.int64)
    for length, n in need.items():
        count[length] = n
    uses, bound = packing.solve(count, 1024)
    assert least <= bound <= optimum + 1e-6
    covered = np.zeros(1025)
    for config, times in uses:
        assert sum(x * a for x, a in config.items()) <= 1024 and times > 0
        for x, a in config.items():
            covered[x] += a * times
    assert (covered <= count + 1e-6).all()
    made, report = packing.rounded(count, 1024)
    assert report["bound"] <= sum(m for _, m in made) <= report["best_fit"]
    assert sum(m for _, m in made) <= np.ceil(optimum) + 1


def test_bound_by_weights_holds_on_random_histograms():
    rng = np.random.default_rng(4)
    for _ in range(12):
        capacity = int(rng.integers(5, 60))
        count = np.zeros(capacity + 1, np.int64)
        for length in rng.integers(1, capacity + 1, int(rng.integers(1, 7))):
            count[length] = rng.integers(1, 50)
        made, report = packing.rounded(count, capacity)
        assert report["bound"] <= sum(m for _, m in made) <= report["best_fit"]
        got = np.zeros(capacity + 1, np.int64)
        for items, m in made:
            assert sum(items) <= capacity
            np.add.at(got, items, m)
        assert (got == count).all()


def test_token_files_are_read_back(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = str(tmp_path / "orc")
    token_files.write(_docs(spark), out, path, drop_space=True, bytes_per_file=4096)
    files = token_files.read(spark, out)
    got = {(r.doc_id, tuple(r.ids)) for r in files.collect()}
    want = {(i, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in [*enumerate(TEXTS), (None, "no id")]}
    assert got == want
    # nulls first, then by id: starts are sums over all before
    order = sorted(want, key=lambda r: (r[0] is not None, r[0]))
    rows = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.summary(files).collect()}
    at, expected = 0, set()
    for i, ids in order:
        expected.add((i, at, len(ids), _crc(ids)))
        at += len(ids)
    assert rows == expected
    assert [tuple(r.ids) for r in files.where("doc_id = 6").collect()] == [ids for i, ids in want if i == 6]
    assert "doc_id" in files.where("doc_id = 6")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_rows_without_id_are_spread_over_files(spark, tmp_path):
    path, out = P.path("word_bpe_49k.json"), str(tmp_path / "orc")
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i} " * 20) for i in range(300)], "doc_id long, text string").repartition(4)
    token_files.write(docs, out, path, drop_space=True, bytes_per_file=4096)
    files = token_files.read(spark, out)
    rows = [(r.doc_id, r.start, r.n_tokens) for r in token_files.summary(files).orderBy("start").collect()]
    assert len(rows) == 300 and [r[0] for r in rows[200:]] == list(range(0, 300, 3)) and not any(r[0] is not None for r in rows[:200])
    assert [a[1] + a[2] for a in rows[:-1]] == [b[1] for b in rows[1:]]
    sizes = files.where("doc_id is null").groupBy(F.shiftright("ord", token_files.FILE_SHIFT)).count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 100


def test_token_files_of_nothing_and_of_repeats(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    token_files.write(_docs(spark).where("doc_id < 0"), str(tmp_path / "none"), path, drop_space=True)
    assert token_files.summary(token_files.read(spark, str(tmp_path / "none"))).collect() == []
    same = spark.createDataFrame([(3, "b"), (3, "a a"), (3, "b"), (1, "c")], "doc_id long, text string")
    token_files.write(same, str(tmp_path / "same"), path, drop_space=True)
    rows = token_files.summary(token_files.read(spark, str(tmp_path / "same"))).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in rows) == [(1, 0, 2), (3, 2, 3), (3, 5, 2), (3, 7, 2)]


def _edited(text, edits):
    for e in edits:
        if e is not None:
            at, cut, put = max(0, e[0] or 0), max(0, e[1] or 0), e[2] or ""
            at = min(at, len(text))
            text = text[:at] + put + text[at + cut :]
    return text


def test_counts_after_edits_in_spark(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    encode = token_counts.vocabulary(path).encode_ordinary
    edits = [(0, 0, "Draft "), None, (700, 40, None), (701, 3, "  "), (None, None, "'s"), (10**6, 5, "\n\n end "), (-3, 2, ""), (650, 1, "é9")]
    rows = [(i, t, edits if i % 2 else edits[::-1], "x") for i, t in enumerate(TEXTS)] + [(50, "plain", None, "x"), (None, "no id", [(2, 1, "")], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:int,del:int,ins:string>>, counts string")
    trees = token_counts.trees(docs, path, keep=["edits"])
    got = {r.doc_id: r for r in trees.collect()}
    done = {r.doc_id: r for r in token_counts.apply_edits(trees, path).collect()}
    for i, t, e, _ in rows:
        assert got[i].n_tokens == len(encode(t or "")) == sum(got[i].counts) and sum(got[i].sizes) == len(t or "")
        after = _edited(t or "", e or [])
        assert done[i].text == after and done[i].n_tokens == len(encode(after)) == sum(done[i].counts)
        assert done[i].n_tokens_before == got[i].n_tokens and done[i].n_edits == sum(x is not None for x in e or [])
    assert token_counts.apply_edits(token_counts.trees(docs.where("doc_id < 0"), path, keep=["edits"]), path).collect() == []


def test_edits_of_long_text_without_spaces_stay_local():
    path = P.path("byte_bpe_50k.tiktoken")
    encode = token_counts.vocabulary(path).encode_ordinary
    text = "abc123,'x;" * 4000
    tree = token_counts.Tree(parts := token_counts.leaves(text), [len(encode(p)) for p in parts])
    assert tree.tokens[1] == len(encode(text)) and max(map(len, parts)) < 2 * token_counts.LEAF
    assert tree.edit(20_000, 3, "7q'", lambda ps: [encode(p) for p in ps]) < 8 * token_counts.LEAF
    assert tree.tokens[1] == len(encode(text[:20_000] + "7q'" + text[20_003:]))
