"""SentencePiece encoding and decoding in batches.

Words of equal length advance together, substring hashes probe the sorted piece keys, and vectorised maxima choose.

``VITERBI`` is one pass over places: the best of all pieces that end there, with back-pointers to where they begin. The
ids are those of the path whose pieces' scores sum highest; of equal paths the one whose last piece is longest, and so
on backward. For a unigram model that is the library's result; scores add up in single precision there, from each
word's beginning (the library's from the text's), so where two paths are equal but for rounding the choices can differ.
A byte-pair model's scores are whole numbers, ranks of merges below zero, and sums are exact.

``LIBRARY`` gives the library's ids for either kind, which the model file tells. A byte-pair model's are by definition
what repeated merging gives, not a path over scores: each step's maximum is each word's best merge, the leftmost of
equals, and words of over ``LONG`` characters go through a heap of merges with the same result. Both decode alike.

Edge cases: a null or empty text has no ids; characters without a piece become byte pieces, or the unknown id, once for
each run of them; U+2581 counts as the space that it stands for, and decodes to one, as in the library; texts come back
exactly otherwise; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as V
from quillspark.llm import tokens as T

SPACE_MARK = 0x2581
#: Kind of a unigram model in a model file, and how far an unknown character's score is below the worst.
UNIGRAM, UNKNOWN = 1, 10.0
#: How ids are chosen: the best path over scores, or as the library does for the model's kind.
VITERBI, LIBRARY = "viterbi", "library"
#: Places in the table that tells most substrings without piece before a search of the sorted keys, a power of two.
SIEVE = 1 << 21
#: Longer words are merged one by one with a heap.
LONG = 256
#: Characters merged at once, bytes encoded at once, ids decoded at once. They bound memory only.
BLOCK, BYTES, IDS = 1 << 18, 1 << 20, 1 << 18


def _fields(proto: bytes) -> Iterable[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            x |= (proto[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if proto[at - 1] < 0x80:
                return x

    while at < len(proto):
        key = number()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if size is None else size
            yield key >> 3, proto[at : at + size]
            at += size


def model_kind(proto: bytes) -> int:
    """Field 3 of the training settings, which are field 2; a unigram model where it is unset."""
    settings = [v for k, v in _fields(proto) if k == 2]
    return ([v for s in settings for k, v in _fields(s) if k == 3] or [UNIGRAM])[-1]


class Codec(T.Encoder):
    def __init__(self, path: str, by: str = LIBRARY):
        import sentencepiece

        if by not in (VITERBI, LIBRARY):
            raise ValueError(f"ids are chosen by {VITERBI} or {LIBRARY}, not by {by}")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unigram = model_kind(sp.serialized_model_proto()) == UNIGRAM
        self.by_path = self.unigram or by == VITERBI
        self.exact = np.float32 if self.unigram else np.float64
        self.special: list[bytes] = []
        n = sp.get_piece_size()
        pieces, ids, scores = [], [], []
        self.unknown = sp.unk_id()
        self.byte_id = np.full(256, self.unknown, np.int64)
        longest = 1
        spell = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                spell[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                spell[i] = piece.replace("▁", " ").encode()
                longest = max(longest, len(piece))
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("pieces go across the beginning of a word")
                pieces.append(piece)
                ids.append(i)
                scores.append(sp.get_score(i))
        size, keys = np.array([len(x) for x in pieces]), np.zeros(len(pieces), np.uint64)
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            words = np.frombuffer("".join(pieces[i] for i in own).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(own), length)
            keys[own] = self._hash(words, np.zeros(len(own), np.int64), np.full(len(own), length), np.arange(len(own)))
        order = np.argsort(keys)
        self.piece_key, self.piece_id, self.piece_score = keys[order], np.array(ids)[order], np.array(scores)[order]
        self.maybe = np.zeros(SIEVE, bool)
        self.maybe[keys & V.U(SIEVE - 1)] = True
        self.longest, self.bytewise = longest, bool((self.byte_id != self.unknown).any())
        self.worst = self.exact(min(scores, default=0.0)) - self.exact(UNKNOWN)
        self.spell_at = np.concatenate(([0], np.cumsum([len(x) for x in spell])))
        self.spelling = np.frombuffer(b"".join(spell), np.uint8)
        self.drop_space = False
        self._forget()

    @staticmethod
    def _prefixes(words: np.ndarray) -> np.ndarray:
        pw, _ = V.powers(words.shape[1])
        h = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
        np.cumsum(V.mix64(words.astype(np.uint64) + V.U(1)) * pw[: words.shape[1]], axis=1, out=h[:, 1:])
        return h

    @classmethod
    def _hash(cls, words: np.ndarray, start, end, row, prefixes: np.ndarray | None = None) -> np.ndarray:
        """Hashes of words[row, start:end]."""
        h = cls._prefixes(words) if prefixes is None else prefixes
        start, end = np.asarray(start), np.asarray(end)
        _, inv = V.powers(words.shape[1])
        return V.mix64((h[row, end] - h[row, start]) * inv[start] ^ ((end - start).astype(np.uint64) * V.U(0xD6E8FEB86659FD93)))

    def _probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the pieces with these hashes; -inf and -1 where there is none."""
        score, ids = np.full(h.shape, -np.inf), np.full(h.shape, -1, np.int64)
        some = np.nonzero(self.maybe[h & V.U(SIEVE - 1)])
        own = h[some]
        k = np.minimum(np.searchsorted(self.piece_key, own), len(self.piece_key) - 1)
        hit = self.piece_key[k] == own
        score[some], ids[some] = np.where(hit, self.piece_score[k], -np.inf), np.where(hit, self.piece_id[k], -1)
        return score, ids

    def _pieces(self, data: np.ndarray, off: np.ndarray, letter: np.ndarray):
        space = data == 0x20
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = space[1:] & ~space[:-1]
        edge[off] = True
        cut = np.flatnonzero(edge)
        return cut[:-1], cut[1:], np.diff(np.searchsorted(cut[:-1], off))

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of the pieces on each equal-length word's best path, in order."""
        n, size = words.shape
        h, (_, inv) = self._prefixes(words), V.powers(size)
        best, back = np.zeros((n, size + 1), self.exact), np.zeros((n, size + 1), np.int32)
        for end in range(1, size + 1):
            start = np.arange(max(0, end - self.longest), end)
            keys = V.mix64((h[:, end : end + 1] - h[:, start]) * inv[start] ^ ((end - start).astype(np.uint64) * V.U(0xD6E8FEB86659FD93)))
            score = self._probe(keys)[0].astype(self.exact)
            # a character that is no piece by itself
            score[:, -1] = np.where(np.isneginf(score[:, -1]), self.worst, score[:, -1])
            total = score + best[:, start]
            # of equals the longest, which is the first to reach this place
            choice = total.argmax(1)
            best[:, end], back[:, end] = total[np.arange(n), choice], start[choice]
        cut = np.zeros((n, size), bool)
        rows, at = np.arange(n), np.full(n, size)
        while len(rows):
            at = back[rows, at]
            cut[rows, at] = True
            rows, at = rows[at > 0], at[at > 0]
        return np.nonzero(cut)

    def merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of the symbols of equal-length words when no merge is left, in order."""
        n, size = words.shape
        prefixes = self._prefixes(words)
        at = np.arange(size + 2)
        nxt = np.broadcast_to(np.minimum(at + 1, size + 1), (n, size + 2)).copy()
        prv = np.broadcast_to(at - 1, (n, size + 2)).copy()
        alive = np.zeros((n, size), bool)
        alive[:] = True
        score = np.full((n, size), -np.inf)
        rows = np.arange(n)
        for i in range(size - 1):
            score[:, i] = self._probe(self._hash(words, np.full(n, i), np.full(n, i + 2), rows, prefixes))[0]
        while len(rows):
            i = score[rows].argmax(1)
            go = score[rows, i] > -np.inf
            rows, i = rows[go], i[go]
            j = nxt[rows, i]
            k = nxt[rows, j]
            alive[rows, j] = False
            score[rows, j] = -np.inf
            nxt[rows, i], prv[rows, k] = k, i
            for a, last in ((i, np.where(k < size, nxt[rows, np.minimum(k, size)], -1)), (prv[rows, i], k)):
                ok = (a >= 0) & (last > 0) & (last <= size)
                r, a, last = rows[ok], a[ok], last[ok]
                score[r, a] = self._probe(self._hash(words, a, last, r, prefixes))[0]
            none = rows[k >= size]
            score[none, i[k >= size]] = -np.inf
        return np.nonzero(alive)

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """Starts of the symbols of one word, by a heap of merges."""
        size = len(word)
        words = word[None, :]
        prefixes = self._prefixes(words)
        nxt, prv = list(range(1, size + 2)), list(range(-1, size))
        end_of = nxt[:size]
        probe = lambda a, b: float(self._probe(self._hash(words, [a], [b], np.zeros(1, np.int64), prefixes))[0][0])
        first = self._probe(self._hash(words, np.arange(size - 1), np.arange(2, size + 1), np.zeros(size - 1, np.int64), prefixes))[0]
        heap = [(-s, i, i + 1, i + 2) for i, s in enumerate(first.tolist()) if s > -np.inf]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not (alive[i] and j < size and alive[j] and nxt[i] == j and end_of[j] == end):
                continue
            alive[j] = False
            nxt[i], end_of[i] = end, end
            if end < size:
                prv[end] = i
                if (s := probe(i, end_of[end])) > -np.inf:
                    heapq.heappush(heap, (-s, i, end, end_of[end]))
            p = prv[i]
            if p >= 0 and (s := probe(p, end)) > -np.inf:
                heapq.heappush(heap, (-s, p, i, end))
        return np.flatnonzero(alive)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        strings = [raw[a:b].decode("utf-8", "replace").replace(" ", "▁") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        size = np.array([len(s) for s in strings])
        order = np.argsort(size, kind="stable")
        kinds, first = np.unique(size[order], return_index=True)
        groups = zip(kinds.tolist(), np.split(order, first[1:]), strict=True)
        blocks = ((length, all_[x : x + max(1, BLOCK // length)]) for length, all_ in groups for x in range(0, len(all_), max(1, BLOCK // length)))
        count, found = np.zeros(len(strings), np.int64), []
        for length, own in blocks:
            words = np.frombuffer("".join(strings[i] for i in own).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(own), length)
            if self.by_path:
                row, at = self.viterbi(words)
            elif length > LONG:
                parts = [self.merge_long(w) for w in words]
                row, at = np.repeat(np.arange(len(own)), [len(p) for p in parts]), np.concatenate(parts)
            else:
                row, at = self.merge(words)
            stop = np.where(np.append(row[1:], -1) == row, np.append(at[1:], 0), length)
            ids = self._probe(self._hash(words, at, stop, row))[1]
            row, ids = self._without_piece(words, row, at, ids)
            count[own] = np.bincount(row, minlength=len(own))
            found.append((own[row], ids))
        to = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        for word, ids in found:
            # ids of a word stand together, in order
            start_of = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            flat[to[word] + np.arange(len(word)) - np.repeat(start_of, np.diff(np.append(start_of, len(word))))] = ids
        return flat, count.astype(np.int32)

    def _without_piece(self, words: np.ndarray, row: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and ids with those of characters that are no piece: their bytes, or one unknown id for each run."""
        missing = ids < 0
        if not missing.any():
            return row, ids
        if not self.bytewise:
            keep = ~missing | np.append(True, ~missing[:-1] | (row[1:] != row[:-1]))
            return row[keep], np.where(missing, self.unknown, ids)[keep]
        letter = words[row[missing], at[missing]]
        size = np.ones(len(ids), np.int64)
        size[missing] += (letter >= 0x80).astype(np.int64) + (letter >= 0x800) + (letter >= 0x10000)
        out = np.repeat(ids, size)
        spelled = letter.astype("<u4").tobytes().decode("utf-32-le").encode()
        out[out < 0] = self.byte_id[np.frombuffer(spelled, np.uint8)]
        return np.repeat(row, size), out

    def encode_texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, after the space that goes before every text that isn't empty."""
        data, off = _plain_spaces(data, off)
        size = np.diff(off)
        lead = (size > 0).astype(np.int64)
        to = np.concatenate(([0], np.cumsum(size + lead)))
        padded = np.full(int(to[-1]), 0x20, np.uint8)
        padded[np.arange(len(data)) + np.repeat(np.cumsum(lead), size)] = data
        return self.encode(padded, to)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each begins, from n[i] ids for text i."""
        size = self.spell_at[ids.astype(np.int64) + 1] - self.spell_at[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        body = self.spelling[np.repeat(self.spell_at[ids] - total[:-1], size) + np.arange(int(total[-1]))]
        upto = total[np.concatenate(([0], np.cumsum(n)))]
        keep = np.ones(len(body), bool)
        some = upto[:-1] < upto[1:]
        first = upto[:-1][some]
        keep[first[body[first] == 0x20]] = False
        return body[keep], np.concatenate(([0], np.cumsum(keep)))[upto]


@functools.lru_cache(maxsize=4)
def codec(path: str, by: str = LIBRARY) -> Codec:
    return Codec(path, by)


def _plain_spaces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U+2581 as a space."""
    mark = np.flatnonzero(data == 0xE2)
    mark = mark[mark + 2 < len(data)]
    mark = mark[(data[mark + 1] == 0x96) & (data[mark + 2] == 0x81)]
    if not len(mark):
        return data, off
    out, keep = data.copy(), np.ones(len(data), bool)
    out[mark] = 0x20
    keep[mark + 1] = keep[mark + 2] = False
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def _encoded(codecs: dict[str, Codec], batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """doc_id, text and a column of ids for each codec."""
    for b in batches:
        for lo, hi, data, off in V.chunks(b.column("text"), BYTES):
            made = []
            for c in codecs.values():
                ids, n = c.encode_texts(data, off)
                made.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("text").slice(lo, hi - lo), *made], ["doc_id", "text", *codecs])


def _decoded(c: Codec, batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for whole in batches:
        lists = whole.column("ids").fill_null([]) if whole.column("ids").null_count else whole.column("ids")
        offsets = lists.offsets.to_numpy()
        lo = 0
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + IDS, "right")) - 1)
            part = lists.slice(lo, hi - lo)
            data, at = c.decode(part.flatten().to_numpy(), np.diff(offsets[lo : hi + 1]))
            raw = data.tobytes()
            made = pa.array([raw[p:q].decode("utf-8", "replace") for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*whole.slice(lo, hi - lo).columns, made], [*whole.schema.names, "decoded"])
            lo = hi


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str, by: str = LIBRARY) -> DataFrame:
    """doc_id, text and ids of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return _encoded({"ids": codec(model, by)}, batches)

    return _rows(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the text of their ids; null ids give an empty text."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return _decoded(codec(model), batches)

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model: str, by: str = LIBRARY) -> DataFrame:
    """``decode`` of ``encode`` in one pass of one worker a task: doc_id, text, ids, the library's ids beside them, and
    decoded, the text of ``ids``, of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        c = codec(model, by)
        return _decoded(c, _encoded({"ids": c, "library_ids": codec(model, LIBRARY)}, batches))

    return _rows(docs).mapInArrow(run, "doc_id long, text string, ids array<int>, library_ids array<int>, decoded string")
