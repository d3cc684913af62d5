"""Encoders against the untouched libraries, on random texts and on a unigram model that the test writes."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import sentencepiece_codec, tokens
from quillspark.llm import textvec as V

P = pytest.importorskip("public_tokenizers")
BITS = ["▁", " ", "a", "the", "日", "🙂", "\n", "é", "xxx", "0", ".", "'s", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|"]


def _random(seed, n, bits=BITS):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


def _each(encode, texts, limit=2000):
    for lo, hi, data, off in V.chunks(pa.array(texts), limit):
        ids, n = encode(data, off)
        at = np.concatenate(([0], np.cumsum(n)))
        for i in range(lo, hi):
            yield texts[i], ids[at[i - lo] : at[i - lo + 1]].tolist()


@pytest.mark.parametrize(("name", "drop"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_with_strings_of_special_tokens(name, drop):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path(name))
    for t, ids in _each(tokens.Encoder(P.path(name), drop).encode, _random(1, 3000)):
        assert ids == plain.encode(t, add_special_tokens=False).ids


def test_byte_pair_pieces_at_every_length():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert not c.unigram
    texts = _random(2, 3000) + [w * k for w in ("x", "ab", "the") for k in (*range(80, 90), *range(126, 132), *range(253, 260))]
    for t, ids in _each(c.encode_texts, texts):
        assert ids == sp.encode(t)


def _number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def _field(k, body):
    return _number(k << 3 | 2) + _number(len(body)) + body


def _unigram(pieces, bytewise):
    out = b"".join(_field(1, _field(1, t.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + _number(k)) for t, s, k in pieces)
    return out + _field(2, b"\x18\x01" + (_number(35 << 3) + b"\x01" if bytewise else b"")) + _field(3, _field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


@pytest.mark.parametrize("bytewise", [False, True])
def test_viterbi_is_the_librarys(tmp_path, bytewise):
    import sentencepiece

    rng = random.Random(3)
    strings = {"▁", *"abc", *("".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(60)), *("▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30))}
    # quarters add up exactly in single precision
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256 if bytewise else 0)), *((s, -rng.randrange(1, 60) / 4, 1) for s in sorted(strings))]
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(_unigram(pieces, bytewise))
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert c.unigram
    for t, ids in _each(c.encode_texts, _random(4, 3000, list("aabbccd éx")) + ["", "abcabc" * 200]):
        assert ids == sp.encode(t)


def test_best_path_of_the_byte_pair_model_is_a_plain_dynamic_programs():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path, sentencepiece_codec.VITERBI)
    known = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    worst = min(s for s, _ in known.values()) - 10
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}

    def best(word):
        # (score, ids) of the best path to each place; of equals the longest last piece, which is tried first
        to = [(0.0, [])]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(end):
                part = word[start:end]
                if part in known:
                    score, ids = known[part][0], [known[part][1]]
                elif end - start == 1:
                    score, ids = worst, [byte[b] for b in part.encode()]
                else:
                    continue
                if top is None or to[start][0] + score > top[0]:
                    top = (to[start][0] + score, to[start][1] + ids)
            to.append(top)
        return to[-1][1]

    rng = random.Random(7)
    spelled = [sp.id_to_piece(i).replace("▁", "") for i in range(300, sp.get_piece_size(), 7)]
    words = ["".join(rng.choice(spelled) for _ in range(rng.randint(1, 4))) for _ in range(1500)] + ["xy" * 300, "é日🙂", "🙂" * 40]
    differ = 0
    for t, ids in _each(c.encode_texts, words):
        assert ids == best("▁" + t)
        differ += ids != sp.encode(t)
    # not the same thing as merging
    assert differ > 0


def test_encoding_in_spark_of_nothing_and_long_words(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "▁ a▁b", "x"), (None, "é" * 2000, "y"), (3, None, "z"), (3, None, "z")], "doc_id long, text string, decoded string")
    rows = sentencepiece_codec.round_trip(docs, path, sentencepiece_codec.VITERBI).collect()
    assert sorted((r.doc_id or 0, r.library_ids) for r in rows) == sorted([(1, sp.encode("▁ a▁b")), (0, sp.encode("é" * 2000)), (3, []), (3, [])])
    assert {len(r.ids) for r in rows if r.text == ""} == {0}
    alone = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path, sentencepiece_codec.VITERBI), path).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in alone) == sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows)
    assert {r.decoded for r in rows} == {"  a b", "é" * 2000, ""}
