"""The branch merge against a merge that builds every branch, and its check sums against zlib."""

import zlib
from collections import Counter

import numpy as np

from quillspark.llm import branch_merge as B

MARK = {1: "!", 2: "?"}


def _code(branch, key, name):
    return zlib.crc32(f"{branch}:{key}:{name}".encode()) % 7


def _branch(branch, key, base, lines):
    columns = {c: "" if (k := _code(branch, key, c)) == 0 else v + MARK.get(k, "") for c, v in base.items()}
    codes = [_code(branch, key, i) for i in range(len(lines))]
    texts = [None if k == 0 else x + MARK.get(k, "") for k, x in zip(codes, lines, strict=True)]
    return _code(branch, key, "row"), columns, texts, [MARK.get(k - 2) for k in codes]


def _text(texts, gaps):
    return "\n".join(x for pair in zip(texts, gaps, strict=True) for x in pair if x is not None)


def brute(rows, left="L", right="R"):
    out = Counter()
    for doc_id, lang, source, text in rows:
        key, base, lines = "" if doc_id is None else doc_id, {"lang": lang or "", "source": source or ""}, (text or "").split("\n")
        (row_l, *one), (row_r, *two) = (_branch(b, key, base, lines) for b in (left, right))
        same = [base, lines, [None] * len(lines)]
        n, state = Counter(), None
        if row_l == 0 or row_r == 0:
            fight = (row_r != 0 and two != same) if row_l == 0 else one != same
            n["ed" if fight else "clean"] += 1
            if fight and row_r != 0:
                state = two
        else:
            def merged(b, x, y, kind):
                if x == b == y:
                    return b
                n["clean" if b in (x, y) or x == y else kind] += 1
                return x if y == b else y

            kinds = ["ed" if None in p else "ee" for p in zip(one[1], two[1], strict=True)]
            state = [{c: merged(base[c], one[0][c], two[0][c], "ee") for c in base}, [merged(*x) for x in zip(lines, one[1], two[1], kinds, strict=True)], [merged(None, x, y, "ii") for x, y in zip(one[2], two[2], strict=True)]]
        out[doc_id, *((state[0]["lang"], state[0]["source"], _text(state[1], state[2])) if state else (None,) * 3), n["clean"], n["ee"], n["ed"], n["ii"]] += 1
        added = [MARK[k - 2] for k in (row_l, row_r) if k in (3, 4)]
        if added:
            out[None if doc_id is None else -1 - doc_id, base["lang"], base["source"], added[-1], int(len(set(added)) == 1), 0, 0, int(len(set(added)) == 2)] += 1
    return out


def test_check_sums_of_names_and_numbers():
    assert [int(x) for x in B.number_sums(12_345)] == [zlib.crc32(str(i).encode()) for i in range(12_345)]
    for left, right in ((b"L", b"R"), (b"mine", b"a branch with a longer name")):
        ids = [b"", b"7", b"-12", b"9223372036854775807"]
        at = B.Prefixes(ids, left, right)
        numbers = np.array([0, 9, 10, 99, 100, 4096, 123_456])
        doc = np.repeat(np.arange(4), len(numbers))
        for got, branch in ((at.name(b"source"), None), (at.lines(doc, np.tile(numbers, 4)), numbers)):
            for codes, b in zip(got, (left, right), strict=True):
                names = [b"source"] if branch is None else [b"%d" % n for n in numbers]
                assert codes.tolist() == [zlib.crc32(b"%b:%b:%b" % (b, i, n)) % 7 for i in ids for n in names]


def test_merge_equals_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "source", "text")
    assert Counter(map(tuple, B.merge(docs).collect())) == brute(map(tuple, docs.collect()))


def test_merge_of_odd_rows(spark):
    long = "\n".join(f"line {i} é日本" for i in range(30_000))
    rows = [(None, None, None, None), (None, "en", "web", "a\nb"), (-5, "", "x", ""), (4, "a", "b", "\n\n\n"), (4, "a", "b", "\n\n\n"), (9_223_372_036_854_775_807, "é", "", "one\r\ntwo\n"), (77, "en", "s", long)]
    rows += [(i, "l", "s", "x" * (i % 3) + "\n" * (i % 7)) for i in range(1000, 1400)]
    docs = spark.createDataFrame([(*r, "own", True) for r in rows], "doc_id long, lang string, source string, text string, n_clean string, l_0 boolean")
    assert Counter(map(tuple, B.merge(docs).collect())) == brute(rows)
    assert B.merge(docs.where("doc_id < -99")).collect() == []
    assert Counter(map(tuple, B.merge(docs, left="main", right="topic/x").collect())) == brute(rows, "main", "topic/x")
