"""Edit-aware token counts: a segment tree of token and character counts over pieces of each document.

A leaf is a run of pre-tokens of at least ``LEAF`` characters, which ends where a space or line feed follows a
character that is not white space, or where letters, digits and other characters meet (but not after an apostrophe).
No pre-token crosses such a place and none depends on what stands on its other side, so counts of leaves add up to the
count of the text. Only a longer run of one kind of characters, which is a single pre-token, is a longer leaf. An edit re-encodes the leaves it touches; where it leaves a border
at which this no longer holds, the neighbour joins in as context. Sums on the paths to the root are then updated.

Edge cases: a null or empty text has no tokens; edits with null parts delete or insert nothing there; positions beyond
the text mean its end, negative ones its start; edits apply one after another, each to the text as it then is; repeated
rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 512
_safe = regex.compile(r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
#: Fixed value: the pattern that splits a text before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts_at(left: str, right: str) -> bool:
    """Whether leaves can meet between two texts that aren't empty."""
    return _safe.match(left[-1] + right[0], 1) is not None


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        m = _safe.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


class Tree:
    """Heaps of sums: node 1 is the root, the leaves start at ``base``."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.parts = parts
        self._raise(tokens)

    def _raise(self, tokens: list[int]) -> None:
        n = max(1, len(self.parts))
        self.base = 1 << (n - 1).bit_length()
        self.tokens, self.chars = np.zeros(2 * self.base, np.int64), np.zeros(2 * self.base, np.int64)
        self.tokens[self.base : self.base + len(tokens)] = tokens
        self.chars[self.base : self.base + len(tokens)] = [len(p) for p in self.parts]
        for heap in (self.tokens, self.chars):
            width = self.base
            while width > 1:
                heap[width // 2 : width] = heap[width : 2 * width : 2] + heap[width + 1 : 2 * width : 2]
                width //= 2

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and the place in it; for the end, the end of the last leaf."""
        if position >= self.chars[1]:
            last = max(0, len(self.parts) - 1)
            return last, len(self.parts[last]) if self.parts else 0
        node = 1
        while node < self.base:
            node *= 2
            if position >= self.chars[node]:
                position -= int(self.chars[node])
                node += 1
        return node - self.base, position

    def _set(self, leaf: int, tokens: int) -> None:
        node = self.base + leaf
        for heap, v in ((self.tokens, tokens), (self.chars, len(self.parts[leaf]))):
            k, change = node, v - heap[node]
            while k:
                heap[k] += change
                k //= 2

    def edit(self, position: int, delete: int, insert: str, encode) -> int:
        """Applies an edit and returns how many characters were encoded again."""
        position = min(max(0, position), int(self.chars[1]))
        a, at = self.find(position)
        b, end = self.find(position + max(0, delete))
        if not self.parts:
            fresh = insert
        else:
            fresh = self.parts[a][:at] + insert + self.parts[b][end:]
        b += bool(self.parts)
        while a > 0 and not (fresh and parts_at(self.parts[a - 1], fresh)):
            a -= 1
            fresh = self.parts[a] + fresh
        while b < len(self.parts) and not (fresh and parts_at(fresh, self.parts[b])):
            fresh += self.parts[b]
            b += 1
        parts = leaves(fresh)
        counts = [len(x) for x in encode(parts)]
        if len(parts) == b - a:
            self.parts[a:b] = parts
            for k, n in enumerate(counts):
                self._set(a + k, n)
        else:
            tokens = self.tokens[self.base : self.base + len(self.parts)].tolist()
            self.parts[a:b] = parts
            self._raise([*tokens[:a], *counts, *tokens[b:]])
        return len(fresh)


def trees(docs: DataFrame, vocabulary_path: str, *, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, sizes (characters of each leaf), counts (tokens of each leaf), n_tokens, and the columns ``keep``."""
    keep = keep or []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode = vocabulary(vocabulary_path).encode_ordinary
        for whole in batches:
            for x in range(0, whole.num_rows, 500):
                b = whole.slice(x, 500)
                cut = [leaves(t) for t in b.column("text").to_pylist()]
                counts = [[len(encode(p)) for p in parts] for parts in cut]
                made = [pa.array([[len(p) for p in parts] for parts in cut], pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array([sum(c) for c in counts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "sizes", "counts", "n_tokens"])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    ints = ArrayType(IntegerType())
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("sizes", ints), StructField("counts", ints), StructField("n_tokens", LongType())]))


def apply_edits(trees_: DataFrame, vocabulary_path: str) -> DataFrame:
    """Applies the column ``edits``, an array of (at int, del int, ins string), to the rows of ``trees``: doc_id, text,
    sizes and counts as they are now, n_tokens_before, n_tokens, n_edits and chars_encoded (encoded for the edits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode_one = vocabulary(vocabulary_path).encode_ordinary
        encode = lambda parts: [encode_one(p) for p in parts]
        for whole in batches:
            for x in range(0, whole.num_rows, 500):
                b = whole.slice(x, 500)
                out: list[list] = [[] for _ in range(7)]
                for text, sizes, counts, edits in zip(*(b.column(c).to_pylist() for c in ("text", "sizes", "counts", "edits")), strict=True):
                    ends = np.cumsum(sizes).tolist()
                    tree = Tree([text[p - s : p] for p, s in zip(ends, sizes, strict=True)], counts)
                    before, work, done = int(tree.tokens[1]), 0, 0
                    for e in edits or []:
                        if e is not None:
                            work += tree.edit(e["at"] or 0, e["del"] or 0, e["ins"] or "", encode)
                            done += 1
                    n = len(tree.parts)
                    for k, v in enumerate(("".join(tree.parts), [len(p) for p in tree.parts], tree.tokens[tree.base : tree.base + n].tolist(), before, int(tree.tokens[1]), done, work)):
                        out[k].append(v)
                types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], NAMES)

    return trees_.select("doc_id", "text", "sizes", "counts", "edits").mapInArrow(run, "doc_id long, text string, sizes array<int>, counts array<int>, n_tokens_before long, n_tokens long, n_edits int, chars_encoded long")


NAMES = ["doc_id", "text", "sizes", "counts", "n_tokens_before", "n_tokens", "n_edits", "chars_encoded"]
