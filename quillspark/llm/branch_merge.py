"""Three-way merge of two branches of a corpus whose edits follow from check sums of ids and names.

A branch edits a document by codes: CRC-32 of ``branch:doc_id:name``, modulo ``CODES``, for its row, each merged column
and each line of its text (named 0, 1...). CRC-32 is linear over XOR, so no string is built for a line: with c the
check sum of the document's prefix ``left:doc_id:``, that of prefix + name is ``crc(name) ^ Z(c)``, where Z moves c on by
as many zero bytes as the name has; and the right branch's check sum is the left's XOR a constant of the length of
what follows the branch's name. One pass over a document's lines then applies both codes, counts, and writes the merged text.

* Columns: 0 empties, 1 appends ``!``, 2 ``?``. Lines: 0 drops, 1 and 2 append, 3 and 4 insert a line ``!`` or ``?`` after.
* Rows: 0 drops, 3 and 4 add a row ``-1 - doc_id`` with the text ``!`` or ``?`` and the base's columns.
* Columns and added rows (both by value), lines, and gaps after lines merge one by one: a change in one branch, or the
  same in both, is clean; of two different ones the right's holds, and they are one conflict (edit-edit; edit-delete if one
  drops a line; insert-insert for gaps and added rows). A dropped row counts once and alone: an edit-delete conflict if
  the other branch keeps the row and changes it, in which the right's state holds, else clean.

Every row is a task's own work: there is no shuffle, and memory follows the longest text.

Edge cases: null columns, texts and ids count as empty text (a null id stays null in the result, so does that of the row it adds);
an empty text is one empty line; rows that share an id, or an added row that has the id of a base row, are merged each
on its own; other columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as V

CODES = 7
#: Of a line: dropped, two marks put at its end, unchanged.
DROP, SAME = 0, 3
MARKS = np.array([0, ord("!"), ord("?"), 0], np.uint8)
_ALL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _table()


def advanced(state: np.ndarray, k: int) -> np.ndarray:
    """The linear part of reading k zero bytes."""
    for _ in range(k):
        state = TABLE[state & 255] ^ (state >> 8)
    return state


@functools.lru_cache(maxsize=1)
def _numbers(size: int) -> np.ndarray:
    out = np.zeros(size, np.uint32)
    out[:10] = [zlib.crc32(b"%d" % i) for i in range(min(size, 10))]
    low = 10
    while low < size:
        i = np.arange(low, min(low * 10, size))
        s = out[i // 10] ^ _ALL
        out[i] = TABLE[(s ^ (48 + i % 10).astype(np.uint32)) & 255] ^ (s >> 8) ^ _ALL
        low *= 10
    return out


def number_sums(n: int) -> np.ndarray:
    """CRC-32 of the decimal numbers 0 to n - 1, each from the number without its last digit."""
    return _numbers(max(1024, 1 << (n - 1).bit_length()))[:n]


@functools.lru_cache(maxsize=4096)
def branch_constant(left: bytes, right: bytes, rest: int) -> int:
    """What the check sums of ``left + x`` and ``right + x`` differ by, for every x of so many bytes."""
    zeros = bytes(rest)
    return zlib.crc32(left + zeros) ^ zlib.crc32(right + zeros)


class Prefixes:
    """Check sums of ``left:doc_id:`` for a batch of ids, and codes of names after them in both branches."""

    def __init__(self, ids: list[bytes], left: bytes, right: bytes):
        self.left, self.right = left, right
        self.sums = np.array([zlib.crc32(b":%b:" % i, start) for start in (zlib.crc32(left),) for i in ids], np.uint32)
        self.rest = np.array([len(i) + 2 for i in ids])
        self.moved = {0: self.sums}

    def _move(self, k: int) -> np.ndarray:
        if k not in self.moved:
            self.moved[k] = advanced(self.sums, k)
        return self.moved[k]

    def _constants(self, k: int) -> np.ndarray:
        values = np.zeros(int(self.rest.max(initial=0)) + 1, np.uint32)
        for n in np.unique(self.rest):
            values[n] = branch_constant(self.left, self.right, int(n) + k)
        return values[self.rest]

    def name(self, name: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The name's codes in either branch, one for each id."""
        sums = self._move(len(name)) ^ np.uint32(zlib.crc32(name))
        return sums % CODES, (sums ^ self._constants(len(name))) % CODES

    def lines(self, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of lines, given the place of their id and their number."""
        low = number_sums(int(number.max(initial=0)) + 1)[number]
        sums, other = np.empty(len(doc), np.uint32), np.empty(len(doc), np.uint32)
        digits = np.ones(len(doc), np.int8)
        top = 10
        while (more := number >= top).any():
            digits += more
            top *= 10
        for k in np.unique(digits):
            own = digits == k
            sums[own] = low[own] ^ self._move(int(k))[doc[own]]
            other[own] = sums[own] ^ self._constants(int(k))[doc[own]]
        return sums % CODES, other % CODES


COUNTS = ("clean", "edit_edit", "edit_delete", "insert_insert")


def transduce(data: np.ndarray, off: np.ndarray, at: Prefixes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The merged texts as bytes and offsets, counts of lines and gaps, and whether either branch changes any of them. Where the
    left branch drops the row, the text is the right branch's, and the counts are of its changes alone."""
    n = len(off) - 1
    # every line, a text's last as well, ends in a line feed until the end
    body = np.insert(data, off[1:], 10)
    end = np.flatnonzero(body == 10)
    size = np.diff(end, prepend=-1)
    first = np.searchsorted(end, off[:-1] + np.arange(n))
    doc = np.repeat(np.arange(n), np.diff(first, append=len(end)))
    left, right = at.lines(doc, np.arange(len(end)) - first[doc])
    lost = (at.name(b"row")[0] == 0)[doc]

    def parts(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(code < SAME, code, SAME), np.where((code == 3) | (code == 4), code - 2, 0)

    (line_l, gap_l), (line_r, gap_r) = parts(left), parts(right)
    per = lambda flags: np.add.reduceat(flags.astype(np.int64), first) if n else np.zeros(0, np.int64)
    found = {"left_changes": per((line_l != SAME) | (gap_l > 0)) > 0, "right_changes": per((line_r != SAME) | (gap_r > 0)) > 0}
    line_l, gap_l = np.where(lost, SAME, line_l), np.where(lost, 0, gap_l)
    clash = (line_l != SAME) & (line_r != SAME) & (line_l != line_r)
    dropped = (line_l == DROP) | (line_r == DROP)
    two = (gap_l > 0) & (gap_r > 0) & (gap_l != gap_r)
    found["clean"] = per(~clash & ((line_l != SAME) | (line_r != SAME))) + per(~two & ((gap_l > 0) | (gap_r > 0)))
    found["edit_edit"], found["edit_delete"], found["insert_insert"] = per(clash & ~dropped), per(clash & dropped), per(two)

    line, gap = np.where(line_r != SAME, line_r, line_l), np.where(gap_r > 0, gap_r, gap_l)
    stays, marked, put = line != DROP, (line == 1) | (line == 2), gap > 0
    after = np.cumsum(np.where(stays, size, 0))
    place = np.stack([after - 1, after, after], 1)
    value = np.stack([MARKS[line], MARKS[gap], np.full(len(gap), 10, np.uint8)], 1)
    some = np.stack([marked, put, put], 1)
    body = np.insert(body[np.repeat(stays, size)], place[some], value[some])
    length = per(np.where(stays, size, 0) + marked + 2 * put)
    ends = np.cumsum(length)
    filled = np.ones(len(body), bool)
    filled[ends[length > 0] - 1] = False
    return body[filled], np.concatenate(([0], np.cumsum(length - (length > 0)))), found


def _edited(base: Column, code: Column) -> Column:
    return F.when(code == 0, F.lit("")).when(code == 1, F.concat(base, F.lit("!"))).when(code == 2, F.concat(base, F.lit("?"))).otherwise(base)


def merge(docs: DataFrame, columns: tuple[str, ...] = ("lang", "source"), left: str = "L", right: str = "R") -> DataFrame:
    """doc_id, the columns, text (these null where the merged corpus has no such row), n_clean, n_edit_edit, n_edit_delete and
    n_insert_insert of every id in the base or either branch."""
    l_name, r_name, names = left.encode(), right.encode(), ["row", *columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"base_{k}") for k, c in enumerate(columns)), F.coalesce("text", F.lit("")).alias("text"))
    fixed = len(columns) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            ids = [b"" if i is None else b"%d" % i for i in b.column(0).to_pylist()]
            for lo, hi, data, off in V.chunks(b.column(fixed), V.CHUNK):
                at = Prefixes(ids[lo:hi], l_name, r_name)
                body, ends, found = transduce(data, off, at)
                text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())
                codes = [pa.array(c.astype(np.int32)) for name in names for c in at.name(name.encode())]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(fixed)), text, *codes, *(pa.array(found[k]) for k in (*COUNTS, "left_changes", "right_changes"))], made)

    coded = [f"{side}_{k}" for k in range(len(names)) for side in "lr"]
    made = ["doc_id", *(f"base_{k}" for k in range(len(columns))), "text", *coded, *COUNTS, "left_changes", "right_changes"]
    schema = ", ".join(["doc_id long", *(f"base_{k} string" for k in range(len(columns))), "text string", *(f"{c} int" for c in coded), *(f"{c} long" for c in COUNTS), "left_changes boolean, right_changes boolean"])
    got = rows.mapInArrow(run, schema)

    base, clean, clash, states = [], F.col("clean"), F.col("edit_edit"), []
    changed = {"l": F.col("left_changes"), "r": F.col("right_changes")}
    row_l, row_r = F.col("l_0"), F.col("r_0")
    for k in range(len(columns)):
        b = F.col(f"base_{k}")
        one, two = _edited(b, F.col(f"l_{k + 1}")), _edited(b, F.col(f"r_{k + 1}"))
        differ = (one != b) & (two != b) & (one != two)
        clean, clash = clean + (((one != b) | (two != b)) & ~differ).cast("long"), clash + differ.cast("long")
        changed = {"l": changed["l"] | (one != b), "r": changed["r"] | (two != b)}
        states.append(F.when((two != b) | (row_l == 0), two).otherwise(one))
        base.append(b)
    none, count = F.lit(None).cast("string"), lambda c: c.cast("long")
    drop = (row_l == 0) | (row_r == 0)
    fought = ((row_l == 0) & (row_r != 0) & changed["r"]) | ((row_r == 0) & (row_l != 0) & changed["l"])
    here = ~drop | (fought & (row_r != 0))

    def record(key: Column, values: list[Column], text: Column, counts: list[Column]) -> Column:
        return F.struct(key.alias("doc_id"), *(v.alias(c) for v, c in zip(values, columns, strict=True)), text.alias("text"), *(c.alias(f"n_{name}") for c, name in zip(counts, COUNTS, strict=True)))

    own = record(
        F.col("doc_id"), [F.when(here, s).otherwise(none) for s in states], F.when(here, F.col("text")).otherwise(none),
        [F.when(drop, count(~fought)).otherwise(clean), F.when(drop, 0).otherwise(clash), F.when(drop, count(fought)).otherwise(F.col("edit_delete")), F.when(drop, 0).otherwise(F.col("insert_insert"))],
    )
    adds_l, adds_r = row_l.isin(3, 4), row_r.isin(3, 4)
    two = adds_l & adds_r & (row_l != row_r)
    mark = F.when(F.when(adds_r, row_r).otherwise(row_l) == 3, "!").otherwise("?")
    zero = F.lit(0).cast("long")
    added = record(-1 - F.col("doc_id"), base, mark, [count(~two), zero, zero, count(two)])
    return got.select(F.inline(F.when(adds_l | adds_r, F.array(own, added)).otherwise(F.array(own))))
