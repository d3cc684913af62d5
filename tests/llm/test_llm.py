import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import jaccard, mtree, packing, quality, sentencepiece_codec, token_counts, tokens
from quillspark.llm import textvec as V

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "\n\n x\t\ty  z \n", None, "don't we'll  HE'S ÀÉ 123 ½", "x..y,, z. ,a .b é, ×, ÷.\n.", "日本語 テキスト 🙂", "\nWord\n Word", "a b c d e f a b c d e g", "ab" * 400 + " end"]


@pytest.mark.parametrize(("name", "drop"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_the_librarys(name, drop):
    e = tokens.Encoder(P.path(name), drop)
    for lo, hi, data, off in V.chunks(pa.array(TEXTS), 40):
        ids, n = e.encode(data, off)
        at = np.concatenate(([0], np.cumsum(n)))
        for i in range(lo, hi):
            assert ids[at[i - lo] : at[i - lo + 1]].tolist() == e.tok.encode(TEXTS[i] or "", add_special_tokens=False).ids


def test_pieces_are_the_librarys():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    (_, _, data, off), = V.chunks(pa.array(TEXTS))
    ids, n = c.encode_texts(data, off)
    body, to = c.decode(ids, n)
    at = np.concatenate(([0], np.cumsum(n)))
    for i, t in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t or "")
        assert body.tobytes()[to[i] : to[i + 1]].decode() == (t or "")


def test_quality_counts():
    (_, _, data, off), = V.chunks(pa.array(TEXTS))
    got = quality.counts(data, off)
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (got["n_words"][i], got["word_chars"][i], got["n_repeat_words"][i]) == (len(w), sum(map(len, w)), len(cover))


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    count = np.bincount(np.minimum(64, rng.geometric(0.05, 3000)), minlength=65)
    count[0] = 0
    p = packing.plan(count, 64)
    assert int(p["sequences"][0]) <= 1.05 * (np.arange(65) * count).sum() / 64 + 1


def test_packing_is_gapless(spark):
    docs = spark.createDataFrame([(1, "a b c " * 900, "x"), (2, None, "y"), (3, "", "z"), (4, "a b", "x"), (4, "a b", "x")], "doc_id long, text string, length string")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows if r.doc_id == 2) == 1


def test_jaccard_join_counts_copies_and_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    near = [*base[:50], "new", *base[51:]]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(near)), (3, "other words here"), (4, None), (5, ""), (5, "")]
    got = {r.doc_id: (r.class_id, r.copy_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 0, 2), 1: (0, 0, 2), 2: (0, 2, 2), 3: (3, 3, 0), 4: (4, 4, 0), 5: (5, 5, 0)}
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5, 5]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (300, 8))
    x[5:40] = x[5]
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(1000, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = {}
    for r in mtree.top_k(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, 300, 50):
        s = x @ x[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, s[i]) for i in best]


def test_edits_count_as_whole_texts(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    encode = token_counts.vocabulary(path).encode_ordinary
    text = "The quick  brown fox.\nJumps over 12 dogs, it's " * 60
    for position, delete, insert in ((0, 0, "x "), (700, 40, ""), (701, 3, "  "), (10**6, 5, "\n\n end "), (-3, 10**7, ""), (900, 0, "é")):
        parts = token_counts.leaves(text)
        tree = token_counts.Tree(parts, [len(encode(p)) for p in parts])
        tree.edit(position, delete, insert, lambda ps: [encode(p) for p in ps])
        at = min(max(0, position), len(text))
        want = text[:at] + insert + text[at + delete :]
        assert "".join(tree.parts) == want and tree.tokens[1] == len(encode(want)) and tree.chars[1] == len(want)


def test_round_trip_in_spark(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, "long " * 9000, "x" * 3000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path)
    for rows in (sentencepiece_codec.round_trip(docs, path), both):
        got = {r.doc_id: (r.ids, r.decoded) for r in rows.collect()}
        assert got == {i: (sp.encode(t or ""), t or "") for i, t in enumerate(texts)}
    assert sentencepiece_codec.round_trip(docs.where("doc_id < 0"), path).collect() == []
