"""Every stage of the pipeline on its own input against brute force, and the order of the stages."""

import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import jaccard, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with rows that are odd and columns that clash."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**9, None, "en", "s", 0), (10**9 + 1, "", "en", "s", 0), (None, "word " * 20_000, "en", "s", 0), (None, "no id but text of more words than ten in all of it here", "en", "s", 0)]
    d = d.unionByName(spark.createDataFrame(odd, d.schema))
    return d.selectExpr("*", "doc_id * 3 as score", "text as quill_text", "doc_id as quill_gone", "'p' as p_quality", "1 as rep", "'l' as length")


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_stage_drops_what_the_model_rejects(spark, docs):
    got = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert got.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.text for r in toxicity.score(docs.select("text"), model).collect() if r.score >= 0.5}
    assert bad and _rows(got) == Counter({k: n for k, n in _rows(docs).items() if k[1] not in bad})
    assert corpus_pipeline.drop_toxic(spark, docs.where("doc_id < 0"), SF).collect() == []


def test_quality_stage_drops_what_the_rules_reject(spark, docs):
    got = corpus_pipeline.keep_quality(spark, docs, SF)
    assert got.columns == docs.columns

    def base_fails(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        return len(w) < 10 or 100 * len(cover) > 20 * len(w)

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = quality.judge(docs.selectExpr("hash(text) as doc_id", "text"), model).select("doc_id", "p_quality").collect()
    p = {r.doc_id: r.p_quality for r in judged}
    key = {r.text: r.h for r in docs.selectExpr("text", "hash(text) as h").collect()}
    want = Counter({k: n for k, n in _rows(docs).items() if not base_fails(k[1]) and p[key[k[1]]] >= quality.KEEP})
    assert _rows(got) == want and 0 < sum(want.values()) < docs.count()
    assert corpus_pipeline.keep_quality(spark, docs.where("doc_id < 0"), SF).collect() == []


def _shingles(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_duplicate_stage_keeps_one_of_each_group(spark, docs):
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    sets = {r.doc_id: _shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    links = Counter()
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    stay = {i for i in ids if find(i) == i}
    assert len(stay) < len(ids)
    assert _rows(got) == Counter({k: n for k, n in _rows(docs).items() if k[0] is None or k[0] in stay})
    joined = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).where("doc_id is not null").collect()}
    assert joined == {i: (find(i), links[i]) for i in ids}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id < 0"), SF).collect() == []


def test_packing_stage_places_every_id(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
