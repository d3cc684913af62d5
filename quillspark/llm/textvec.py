"""Vectorised text primitives on the byte buffers of Arrow string columns.

All functions work on a chunk: ``data`` (uint8 bytes of several texts) and ``off`` (where each text starts, one more
entry than texts). Nulls count as empty texts. A chunk holds about ``CHUNK`` bytes, or one text if that is longer, so
memory follows the longest text and not the batch.

Words, lines and n-grams are identified by 64-bit hashes of their whole content and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)

#: Fixed value: the bytes that end a word, \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and every byte of a character beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_KEY = mix64(np.arange(1, 257, dtype=np.uint64) * U(_P))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_P, _INV)):
            a = np.full(n + 1, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    pw, inv = _powers
    if n <= CHUNK * 2 < len(pw):  # a long text came by: don't hold its tables
        _powers[:] = [pw[: CHUNK + 1].copy(), inv[: CHUNK + 1].copy()]
    return pw, inv


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, off) of slices of a string column; every row is in one slice."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lowered(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z in lower case; with ``latin`` also the letters U+00C0 to U+00DE."""
    out = LOWER[data]
    if latin and len(out) > 1:
        up = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of True; no run crosses texts."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    a, b = off[:-1], off[1:]
    some = b > a
    first[a[some]] = inside[a[some]]
    last[b[some] - 1] = inside[b[some] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span, whatever its place."""
    n = len(data)
    pw, inv = powers(n)
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum(BYTE_KEY[data] * pw[:n], out=h[1:])
    return mix64((h[end] - h[start]) * inv[start] ^ ((end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words within one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = h[:n].copy()
    for j in range(1, k):
        s = mix64(s * U(0x9FB21C651E98DF25) + h[j : n + j])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, s[at]


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word k-grams in order of texts, and where each text's begin. A text of fewer than k words has one
    shingle of all its words; a text without words has none."""
    at, s = windows(h, doc, k)
    d = doc[at]
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    extra_d, extra_s = [], []
    for c in range(1, k):
        few = np.flatnonzero(count == c)
        if len(few):
            x = h[first[few]].copy()
            for j in range(1, c):
                x = mix64(x * U(0x9FB21C651E98DF25) + h[first[few] + j])
            extra_d.append(few)
            extra_s.append(mix64(x + U(c)))
    if extra_d:
        d, s = np.concatenate([d, *extra_d]), np.concatenate([s, *extra_s])
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
    return s, np.searchsorted(d, np.arange(n_docs + 1))


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of per-byte values over each text."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]
