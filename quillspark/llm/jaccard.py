"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

A document's set holds the hashes of its word 5-grams (words are runs of letters and digits, lower case; a text of one
to four words has one n-gram of all its words). Documents with equal sets are one class, its representative being the
smallest id. Representatives get a signature, cut into ``bands`` bands of ``rows`` values, the numbers chosen so that
a pair at the threshold meets in some band with probability ``recall``; band hashes are shuffled, and buckets with
equal members are joined once. A bucket whose sets are large together is cut into blocks, and each pair of blocks is a
group of its own, so no task holds more than two blocks. A group counts, for each representative, the links to the
others by products of incidence matrices and gives a spanning forest of its links; pairs are never written out. A pair
counts in the first band in which it meets only.

Edge cases: a null text, or one without words, has no n-grams and no links and is a class of its own; of rows that
share an id the one with the smallest set hash takes part; a row without id is in no class and has no links; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import components, store
from quillspark.llm import textvec as V

WORDS, THRESHOLD, RECALL, ROWS = 5, (4, 5), 0.999, 6
BLOCK_BYTES, BLOCK_ROWS, TILE = 4 << 20, 4096, 512


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands of ``rows`` rows in which a pair at the threshold meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and where each text's begin."""
    low = V.lowered(data, latin=True)
    start, end, doc = V.runs(V.ALNUM[low], off)
    s, at = V.shingles(V.span_hashes(low, start, end), doc, len(off) - 1, words)
    each = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(each) if each else s), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)


def fingerprints(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two arrays."""
    out = []
    for k in (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(V.mix64(s * V.U(k)), dtype=np.uint64)))
        out.append(V.mix64(c[at[1:]] - c[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(s: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes, one row of ``bands`` for each set; those of empty sets mean nothing."""
    n = len(at) - 1
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((n, bands), np.uint64)
    if len(some):
        starts = at[some]
        seeds = V.mix64(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * V.U(0xC2B2AE3D27D4EB4F))
        for b in range(bands):
            h = np.full(len(some), b + 1, np.uint64)
            for r in range(rows):
                k = 2 * (b * rows + r)
                h = V.mix64(h * V.U(0x9FB21C651E98DF25) + np.minimum.reduceat((s ^ seeds[k]) * (seeds[k + 1] | V.U(1)), starts))
            out[some, b] = h
    return out.view(np.int64)


def sketches(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(doc_id, hi, lo, n, bands) of every document: fingerprint and size of its set, and its band hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), V.CHUNK // 2):
                s, at = sets(data, off, words)
                f, g = fingerprints(s, at)
                sig = signatures(s, at, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(f), pa.array(g), pa.array(np.diff(at)), lists], ["doc_id", "hi", "lo", "n", "bands"])

    rows_ = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows_.mapInArrow(run, "doc_id long, hi long, lo long, n long, bands array<long>")


def block_rows(batches: Iterable[pa.RecordBatch], words: int) -> Iterable[pa.RecordBatch]:
    """For every representative with its buckets (band, key, blocks), a row with its set for every group it is in."""
    for b in batches:
        rep, buckets = b.column("rep").to_numpy(), b.column("buckets").to_pylist()
        want_hi, want_lo, copies = (b.column(c).to_numpy() for c in ("hi", "lo", "copies"))
        sig = b.column("bands").to_pylist()
        for lo, hi, data, off in V.chunks(b.column("text"), V.CHUNK // 2):
            s, at = sets(data, off, words)
            f, g = fingerprints(s, at)
            out: dict[str, list] = {c: [] for c in ("band", "key", "bi", "bj", "side", "rep", "copies", "sig", "set")}
            for i in range(hi - lo):
                k = lo + i
                if f[i] != want_hi[k] or g[i] != want_lo[k]:
                    continue  # another row with this id
                whole, sign = s[at[i] : at[i + 1]].tobytes(), np.array(sig[k], np.int64).tobytes()
                place = int(V.mix64(np.array([rep[k]], np.int64).view(np.uint64))[0])
                for x in buckets[k]:
                    own, blocks = place % x["blocks"], x["blocks"]
                    for other in range(blocks):
                        for name, v in zip(out, (x["band"], x["key"], min(own, other), max(own, other), int(own > other), int(rep[k]), int(copies[k]), sign, whole), strict=True):
                            out[name].append(v)
                    if sum(map(len, out["set"][-blocks:])) and len(out["rep"]) >= 512:
                        yield _rows(out)
            if out["rep"]:
                yield _rows(out)


ROW = pa.schema([("band", pa.int32()), ("key", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("side", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("sig", pa.binary()), ("set", pa.binary())])


def _rows(out: dict[str, list]) -> pa.RecordBatch:
    made = pa.RecordBatch.from_pydict(out, ROW)
    for v in out.values():
        v.clear()
    return made


def links(sizes: np.ndarray, cols: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, wanted: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which of the wanted pairs of rows a x b reach the threshold; cols[at[i]:at[i + 1]] is the set of row i."""
    num, den = threshold
    few = np.argwhere(wanted)
    out = np.zeros_like(wanted)
    if len(few) * 50 < wanted.size or len(few) < 8:
        for i, j in few:
            x, y = a[i], b[j]
            both = len(np.intersect1d(cols[at[x] : at[x + 1]], cols[at[y] : at[y + 1]], assume_unique=True))
            out[i, j] = (num + den) * both >= num * (sizes[x] + sizes[y])
        return out

    def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = at[rows + 1] - at[rows]
        return np.repeat(np.arange(len(rows)), n), cols[np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    (ra, ca), (rb, cb) = flat(a), flat(b)
    common = np.intersect1d(ca, cb)
    both = np.zeros(wanted.shape, np.float32)
    ka, kb = np.searchsorted(common, ca), np.searchsorted(common, cb)
    ka[(ka == len(common))] = 0
    kb[(kb == len(common))] = 0
    if len(common):
        ia, ib = common[ka] == ca, common[kb] == cb
        for x in range(0, len(common), 4096):
            w = min(4096, len(common) - x)
            m = []
            for r, k, ok, n in ((ra, ka, ia, len(a)), (rb, kb, ib, len(b))):
                d = np.zeros((n, w), np.float32)
                sel = ok & (k >= x) & (k < x + w)
                d[r[sel], k[sel] - x] = 1
                m.append(d)
            both += m[0] @ m[1].T
    return wanted & ((num + den) * both >= num * (sizes[a][:, None] + sizes[b][None, :]))


def verify_group(band: int, same: bool, side: np.ndarray, rep: np.ndarray, copies: np.ndarray, sig: np.ndarray, raw: list[bytes], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, copies in linked other classes, root in the group's forest) of the linked rows of a group. Between two
    blocks only pairs of different sides count, within a block all."""
    _, once = np.unique(rep, return_index=True)
    side, rep, copies, sig, raw = side[once], rep[once], copies[once], sig[once], [raw[i] for i in once]
    values = np.frombuffer(b"".join(raw), np.uint64)
    sizes = np.array([len(x) // 8 for x in raw], np.int64)
    _, cols, count = np.unique(values, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rep)), sizes)
    shared = count[cols] > 1
    cols, row = cols[shared], row[shared]
    at = np.searchsorted(row, np.arange(len(rep) + 1))
    got, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    num, den = threshold
    for x in range(0, len(left), TILE):
        a = left[x : x + TILE]
        for y in range(x if same else 0, len(right), TILE):
            b = right[y : y + TILE]
            wanted = np.minimum(sizes[a][:, None], sizes[b]) * den >= np.maximum(sizes[a][:, None], sizes[b]) * num
            if same and x == y:
                wanted &= np.triu(np.ones_like(wanted), 1)
            wanted &= sig[a, band][:, None] == sig[b, band]
            for e in range(band):
                wanted &= sig[a, e][:, None] != sig[b, e]
            if not wanted.any():
                continue
            hit = links(sizes, cols, at, a, b, wanted, threshold)
            got[a] += hit @ copies[b]
            got[b] += copies[a] @ hit
            first = hit.argmax(1)
            for i in np.flatnonzero(hit.any(1)):
                # joining every linked column to the row's first link, then the row to it, spans the row's links
                js = b[np.flatnonzero(hit[i])] if hit[i].sum() < TILE else b
                r = find(a[i])
                for j in js if len(js) < 4 else js[np.unique(root[js], return_index=True)[1]]:
                    q = find(j)
                    if q != r:
                        lo, hi = (q, r) if rep[q] < rep[r] else (r, q)
                        root[hi] = lo
                        r = lo
            del first
    linked = np.flatnonzero(got)
    return rep[linked], got[linked], rep[np.array([find(i) for i in linked], np.int64)] if len(linked) else rep[linked]


def verify(batches: Iterable[pa.RecordBatch], bands: int, threshold: tuple[int, int]) -> Iterable[pa.RecordBatch]:
    """Runs ``verify_group`` on each run of rows with an equal group key; rows come sorted by it."""
    held: list[pa.RecordBatch] = []

    def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.int64).reshape(-1, bands)
        rep, got, root = verify_group(t["band"][0].as_py(), t["bi"][0] == t["bj"][0], *(t[c].to_numpy() for c in ("side", "rep", "copies")), sig, t["set"].to_pylist(), threshold)
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(got), pa.array(root)], ["rep", "links", "root"])

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "bi", "bj")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and (keys[x] != last).any():
                yield done(held)
                held = []
            last = keys[x]
            held.append(b.slice(x, y - x))
    if held:
        yield done(held)


def join(docs: DataFrame, *, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id among the documents that links connect), copy_id (smallest id among those with an
    equal set) and n_links (other documents at the threshold or above, copies included) of every document."""
    bands = bands_for(threshold[0] / threshold[1], rows, recall)
    sk = sketches(docs, bands, rows, words).groupBy("doc_id").agg(F.min(F.struct("hi", "lo", "n", "bands")).alias("s")).select("doc_id", "s.*")
    sk = store.kept(sk, "sketches")
    classes = sk.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("bands").alias("bands"))
    classes = store.kept(classes, "classes")
    members = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(
        F.count("*").alias("c"), F.sum("n").alias("total"), F.min("rep").alias("r0"), F.max("rep").alias("r1"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("y")
    ).where("c > 1")
    # buckets with equal members would give equal pairs; the first band's is the one in which they count
    buckets = buckets.groupBy("c", "total", "r0", "r1", "x", "y").agg(F.min(F.struct("band", "key")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("total") * 8 / BLOCK_BYTES), F.ceil(F.col("c") / BLOCK_ROWS)).cast("int")
    buckets = buckets.select("b.band", "b.key", blocks.alias("blocks"))
    mine = members.join(buckets, ["band", "key"]).groupBy("rep").agg(F.collect_list(F.struct("band", "key", "blocks")).alias("buckets"))
    reps = mine.join(classes, "rep").select("rep", "copies", "hi", "lo", "bands", "buckets")
    text = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    moved = text.join(reps, "rep").mapInArrow(lambda it: block_rows(it, words), "band int, key long, bi int, bj int, side int, rep long, copies long, sig binary, set binary")
    key = ["band", "key", "bi", "bj"]
    found = moved.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda it: verify(it, bands, threshold), "rep long, links long, root long")
    found = store.kept(found, "links")
    roots = components.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.select("hi", "lo", "rep", "copies").join(sums, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("hi", "lo", F.col("rep").alias("copy_id"), F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rest = sk.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    none = F.lit(None).cast("long")
    nameless = docs.where("doc_id is null").select(none.alias("doc_id"), none.alias("class_id"), none.alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return sk.where("n > 0").select("doc_id", "hi", "lo").join(per_class, ["hi", "lo"]).select("doc_id", "class_id", "copy_id", "n_links").unionByName(rest).unionByName(nameless)


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """docs without the documents of each class but the one with the smallest id; rows without id stay."""
    gone = join(docs, **settings).where("doc_id <> class_id").select("doc_id")
    return docs.alias("mine").join(gone.alias("gone"), F.col("mine.doc_id") == F.col("gone.doc_id"), "left_anti")
