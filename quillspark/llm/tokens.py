"""Token ids by the ``tokenizers`` library.

A text is cut where ASCII white space follows another character, and before ``.`` or ``,`` after a letter. No
pre-token of the two vocabularies crosses such a place, so the ids of a text are the ids of its pieces, one after
another, and each worker has the library encode a distinct piece once. A piece of letters only is one pre-token and
goes to the library's model at once, others pass its whole chain. A text that may hold the string of a special token
goes to the library as a whole. ``tests/llm`` compares with the untouched library's encoding of whole texts.

Pieces are known by 64-bit hashes of their bytes and length. Two different ones among the at most ``REMEMBER`` that a
worker knows share a hash with a probability of about 1e-7.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np

from quillspark.llm import textvec as V

#: Pieces that a worker remembers; beyond this it starts anew. Bounds memory only, ids don't depend on it.
REMEMBER = 2_000_000
TOKEN_CHUNK = 1 << 22


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if it shows, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def letters(data: np.ndarray) -> np.ndarray:
    """True for the bytes of A-Z, a-z and the letters U+00C0 to U+00FF."""
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    if len(data) < 2:
        return ascii_letter
    second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & ((data[1:] & 0xDF) != 0x97)
    ascii_letter[1:] |= second
    ascii_letter[:-1] |= second
    return ascii_letter


class Encoder:
    """drop_space: the vocabulary lower-cases and drops white space, so that pieces are words. Else a piece begins
    with the white space before its word, and white space at the end of a text is a piece."""

    def __init__(self, path: str, drop_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = sorted({t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()})
        self.model = self.tok.model
        self.symbols = {b: ord(c) for b, c in enumerate(byte_symbols())}
        self.drop_space = drop_space
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def _pieces(self, data: np.ndarray, off: np.ndarray, letter: np.ndarray):
        """Start and end of the pieces, and how many each text has."""
        space = V.SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = (space[1:] & ~space[:-1]) | (((data[1:] == 0x2E) | (data[1:] == 0x2C)) & letter[:-1])
        edge[off] = True
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        if self.drop_space:
            # at most the white space before the word stands in a piece
            gap = np.concatenate(([0], np.cumsum(space, dtype=np.int64)))
            start = start + (gap[end] - gap[start])
            some = start < end
            start, end = start[some], end[some]
        return start, end, np.diff(np.searchsorted(start, off))

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.concatenate(([0], np.cumsum(~letter, dtype=np.int64)))
        lead = 0 if self.drop_space else (data[start] == 0x20).astype(np.int64)
        simple = (odd[end] - odd[start] == lead) & (end - start > lead)
        raw, tokenize, symbols = data.tobytes(), self.model.tokenize, self.symbols
        lists: list = [None] * len(start)
        rest = []
        for i, (a, b, one) in enumerate(zip(start.tolist(), end.tolist(), simple.tolist(), strict=True)):
            if one:
                lists[i] = [t.id for t in tokenize(raw[a:b].decode("latin-1").translate(symbols))]
            else:
                rest.append(i)
        if rest:
            found = self.tok.encode_batch_fast([raw[start[i] : end[i]].decode("utf-8", "replace") for i in rest], add_special_tokens=False)
            for i, x in zip(rest, found, strict=True):
                lists[i] = x.ids
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _with_special(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The texts that hold the string of a special token, in whatever case."""
        raw, found = V.LOWER[data].tobytes(), set()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                found.add(i)
                at = raw.find(s, int(off[i + 1]))
        return np.array(sorted(found), np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has)."""
        whole = self._with_special(data, off)
        if not len(whole):
            return self._encode(data, off)
        raw, lists, sizes, done = data.tobytes(), [], [], 0
        for i in [*whole.tolist(), len(off) - 1]:
            if done < i:
                ids, n = self._encode(data[off[done] : off[i]], off[done : i + 1] - off[done])
                lists.append(ids.astype(np.uint32))
                sizes.append(n)
            if i < len(off) - 1:
                own = self.tok.encode(raw[off[i] : off[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids
                lists.append(np.array(own, np.uint32))
                sizes.append(np.array([len(own)], np.int64))
            done = i + 1
        return np.concatenate(lists), np.concatenate(sizes)

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.drop_space:
            data = V.lowered(data, latin=True)
        letter = letters(data)
        start, end, each = self._pieces(data, off, letter)
        if not len(start):
            return self.ids[:0], np.zeros(len(off) - 1, np.int64)
        uniq, first, inverse = np.unique(V.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBER:
            self._forget()
        k = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        if len(self.keys):
            new = self.keys[np.minimum(k, len(self.keys) - 1)] != uniq
        if new.any():
            ids, size = self._learn(data, start[first[new]], end[first[new]], letter)
            if len(ids) and ids.max() >= 1 << 16 and self.ids.dtype == np.uint16:
                self.ids = self.ids.astype(np.uint32)
            self.slot = np.insert(self.slot, k[new], len(self.at) + np.arange(len(size), dtype=np.int32))
            self.keys = np.insert(self.keys, k[new], uniq[new])
            self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size, dtype=np.int64) - size))
            self.size = np.concatenate((self.size, size))
            self.ids = np.concatenate((self.ids, ids.astype(self.ids.dtype)))
            k = k + np.cumsum(new) - new
        slot = self.slot[k][inverse]
        size, at = self.size[slot].astype(np.int64), self.at[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(int(total[-1]))]
        upto = np.concatenate(([0], np.cumsum(each)))
        return ids, total[upto[1:]] - total[upto[:-1]]


@functools.lru_cache(maxsize=4)
def encoder(path: str, drop_space: bool) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path, drop_space)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
