"""Exact top-k search by inner product in a paged M-tree.

The tree has three levels. At the top, vectors belong to the nearest of a bounded sample of pivots; a pivot's ball has
the covering radius of all its vectors. Below are pages, parts of a ball of at most ``PAGE`` vectors by a hash of their
id, so that many equal vectors fill many pages; a page has a routing vector and its own radius. A page holds nodes with
a pivot, a covering radius and the distance to the page's pivot, and entries with the distance to their node's pivot.
For a query q and a ball (c, r) no inner product exceeds <q, c> + |q| r, and by the triangle inequality <q, c> is at
most <q, parent> + |q| d(c, parent), so stored distances often spare both the product with a pivot and those with
entries.

The search goes best first at each level. In a first round every query visits one group of pages of the ball with the
highest bound, which gives it k scores. In a second it goes only to the balls whose bound reaches its k-th score, and
in their groups to pages, and in pages to nodes, in falling order of their bounds, until a bound is below the k-th best
so far; equal bounds are visited, for ties. Queries meet pages in a co-grouping by (group of pages, part of the
queries): a group is at most ``GROUP`` vectors and a part about ``PART`` queries, so a task's memory is bounded, and a
vector is sent as often as there are parts whose queries can still win something there. All arithmetic on whole numbers
is exact below 2**53.

Edge cases: vectors that are null or hold null or non-finite components take no part; rows without id neither; shorter
vectors count as filled up with zeros; fewer than k candidates are all returned; ties go to smaller ids; rows with the
same vector and different ids are different candidates; an empty table gives no rows; other columns are ignored. Ids
should be unique.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import store
from quillspark.llm import textvec as V

#: Rows for each pivot, most pivots, rows of a page, entries of a node, rows of a group, queries of a part.
PER_PIVOT, MAX_PIVOTS, PAGE, NODE, GROUP, PART = 2048, 512, 4096, 64, 1 << 15, 1 << 14


def whole(df: DataFrame, vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component x, or null where the vector takes no part."""
    x = F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), x)


def matrix(col: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of lists as float64, filled up with zeros or cut to ``width``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = at < width
    out[row[keep], at[keep]] = flat[keep]
    return out


def fitted(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0))


class Page:
    """Nodes over the rows of one page."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        self.pivot = x[0]
        # farthest-first pivots keep the radii small
        far, chosen = distances(x, x[:1])[:, 0], [0]
        near = np.zeros(len(x), np.int64)
        while len(chosen) < -(-len(x) // NODE) and far.max() > 0:
            chosen.append(int(far.argmax()))
            d = distances(x, x[chosen[-1:]])[:, 0]
            near[d < far] = len(chosen) - 1
            far = np.minimum(far, d)
        self.centre = x[chosen]
        by = np.argsort(near, kind="stable")
        self.at = np.searchsorted(near[by], np.arange(len(chosen) + 1))
        self.ids, self.x, self.parent = ids[by], x[by], far[by]
        self.radius = np.maximum.reduceat(self.parent, self.at[:-1])
        self.to_page = distances(self.centre, self.pivot[None, :])[:, 0]
        self.reach = float((self.to_page + self.radius).max())


def search(page: Page, q: np.ndarray, qid: np.ndarray, score: np.ndarray, got: np.ndarray, floor: np.ndarray) -> int:
    """Updates each query's best scores and ids with a page's rows, best node first; products computed."""
    k = score.shape[1]
    q = fitted(q, page.x.shape[1])
    norm = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
    slack = 1e-6
    least = np.maximum(score[:, -1], floor)
    first = (q @ page.pivot)[:, None] + norm[:, None] * (page.to_page + page.radius)[None, :] + slack >= least[:, None]
    rows, nodes = np.flatnonzero(first.any(1)), np.flatnonzero(first.any(0))
    if not len(rows):
        return len(q)
    to_node = np.full(first.shape, -np.inf)
    to_node[np.ix_(rows, nodes)] = q[rows] @ page.centre[nodes].T
    bound = np.where(first, to_node + norm[:, None] * page.radius + slack, -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    done = len(rows) * len(nodes)
    for step in range(order.shape[1]):
        node = order[:, step]
        go = np.flatnonzero(bound[np.arange(len(q)), node] >= np.maximum(score[:, -1], floor))
        go = go[np.isfinite(bound[go, node[go]])]
        if not len(go):
            break
        for n in np.unique(node[go]):
            s = go[node[go] == n]
            a, b = page.at[n], page.at[n + 1]
            least = np.maximum(score[s, -1], floor[s])
            near = to_node[s, n][:, None] + norm[s][:, None] * page.parent[a:b] + slack >= least[:, None]
            cols = a + np.flatnonzero(near.any(0))
            new = q[s] @ page.x[cols].T
            done += new.size
            ids = np.broadcast_to(page.ids[cols], new.shape)
            new = np.where(ids == qid[s][:, None], -np.inf, new)
            every, who = np.concatenate((score[s], new), 1), np.concatenate((got[s], ids), 1)
            best = np.lexsort((who, -every), axis=-1)[:, :k]
            score[s], got[s] = np.take_along_axis(every, best, 1), np.take_along_axis(who, best, 1)
    return done


def search_group(ids: np.ndarray, x: np.ndarray, page_of: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of every query's k best in the pages of a group that reach ``floor``, best page first."""
    pages = [Page(ids[page_of == p], x[page_of == p]) for p in np.unique(page_of)]
    score, got = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
    norm = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
    bound = np.stack([fitted(q, p.x.shape[1]) @ p.pivot + norm * p.reach + 1e-6 for p in pages], 1)
    order = np.argsort(-bound, axis=1, kind="stable")
    for step in range(len(pages)):
        at = order[:, step]
        go = np.flatnonzero(bound[np.arange(len(qid)), at] >= np.maximum(score[:, -1], floor))
        if not len(go):
            break
        for p in np.unique(at[go]):
            own = go[at[go] == p]
            s, g = score[own], got[own]
            search(pages[p], q[own], qid[own], s, g, floor[own])
            score[own], got[own] = s, g
    some = np.isfinite(score) & (score >= floor[:, None])
    return np.repeat(qid, some.sum(1)), got[some], score[some].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best. Both tables have (vec_id long, v array<long>); a row is
    no candidate for a query with its id."""
    clean = lambda df: df.where("vec_id is not null and v is not null").select("vec_id", "v")
    vectors, queries = clean(vectors), clean(queries)
    pivots = max(1, min(MAX_PIVOTS, vectors.count() // PER_PIVOT))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(pivots, 4 * k)).collect()
    width = max((len(r["v"]) for r in sample), default=0)
    known_id = np.array([r["vec_id"] for r in sample], np.int64)
    known = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in sample], np.float64).reshape(len(sample), width)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            rest = (x[:, width:] ** 2).sum(1)  # of vectors longer than the sampled ones
            d = distances(fitted(x, width), known[:pivots])
            near = d.argmin(1)
            far = np.sqrt(d[np.arange(len(near)), near] ** 2 + rest) * (1 + 1e-9) + 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(far), b.column("vec_id"), b.column("v")], ["pivot", "far", "vec_id", "v"])

    placed = vectors.mapInArrow(assign, "pivot long, far double, vec_id long, v array<long>")
    # one row for each pivot reaches the driver
    balls = {r["pivot"]: r for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    if not balls:
        return placed.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("pivot").alias("score")).limit(0)
    groups = np.array([-(-balls[p]["n"] // GROUP) if p in balls else 0 for p in range(pivots)])
    first = np.concatenate(([0], np.cumsum(groups)))
    radius = np.array([balls[p]["radius"] if p in balls else -np.inf for p in range(pivots)])
    parts = max(1, -(-queries.count() // PART))
    lookup = F.array(*map(F.lit, groups.tolist())), F.array(*map(F.lit, first[:-1].tolist()))
    many, start = (F.get(a, F.col("pivot").cast("int")) for a in lookup)
    group = (start + F.pmod(F.xxhash64("vec_id", F.lit(3)), many)).cast("long")
    placed = placed.select(group.alias("grp"), "vec_id", "v")

    def bounds(x: np.ndarray) -> np.ndarray:
        q = fitted(x, width)
        return q @ known[:pivots].T + np.sqrt((x * x).sum(1) * (1 + 1e-12))[:, None] * radius + 1e-6

    ASK = "grp long, part long, query_id long, v array<long>, floor double"

    def asked(b: pa.RecordBatch, row: np.ndarray, grp: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
        ids = b.column("vec_id").take(pa.array(row))
        part = V.mix64(ids.to_numpy().view(np.uint64)) % V.U(parts)
        return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(part.astype(np.int64)), ids, b.column("v").take(pa.array(row)), pa.array(floor)], ["grp", "part", "query_id", "v", "floor"])

    def home(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Every query to one group of the ball with the highest bound."""
        for b in batches:
            x, ids = matrix(b.column("v")), b.column("vec_id").to_numpy()
            near = bounds(x).argmax(1)
            grp = first[near] + (V.mix64(ids.view(np.uint64)) % groups[near].astype(np.uint64)).astype(np.int64)
            # the k-th best of the sampled rows is a bound from below for the k-th best of all
            s = np.where(known_id[None, :] == ids[:, None], -np.inf, fitted(x, width) @ known.T)
            s = np.sort(s, 1)[:, ::-1]
            floor = s[:, k - 1] if s.shape[1] >= k else np.full(len(ids), -np.inf)
            yield asked(b, np.arange(len(ids)), grp, floor)

    def onward(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        """Every query to all groups that can hold one of its k best, but the one it has seen."""
        for b in batches:
            reach = bounds(matrix(b.column("v"))) >= b.column("floor").to_numpy()[:, None]
            row, ball = np.nonzero(reach)
            n = groups[ball]
            row, grp = np.repeat(row, n), np.repeat(first[ball], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new = grp != b.column("seen").to_numpy()[row]
            if new.any():
                yield asked(b, row[new], grp[new], b.column("floor").to_numpy()[row[new]])

    def answer(page_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "grp"]
        if not page_rows.num_rows or not query_rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        x, q = matrix(page_rows["v"]), matrix(query_rows["v"])
        wide = max(x.shape[1], q.shape[1])
        ids = page_rows["vec_id"].to_numpy()
        page = (V.mix64(ids.view(np.uint64) + V.U(5)) % V.U(-(-len(ids) // PAGE))).astype(np.int64)
        found = search_group(ids, fitted(x, wide), page, query_rows["query_id"].to_numpy(), fitted(q, wide), query_rows["floor"].to_numpy(), k)
        return pa.table([*map(pa.array, found), pa.array(np.full(len(found[0]), query_rows["grp"][0].as_py()))], names=names)

    def visit(ask: DataFrame) -> DataFrame:
        want = ask.select(F.col("grp").alias("a_grp"), F.col("part").alias("a_part")).distinct()
        where = placed.join(want, F.col("grp") == F.col("a_grp")).select("a_grp", "a_part", "vec_id", "v")
        return where.groupBy("a_grp", "a_part").cogroup(ask.groupBy("grp", "part")).applyInArrow(answer, "query_id long, vec_id long, score long, grp long")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    sent = store.kept(queries.mapInArrow(home, ASK), "home")
    one = store.kept(visit(sent), "first-round")
    kth = best(one).groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("kth"))
    floor = F.greatest("floor", F.when(F.col("c") >= k, F.col("kth")).cast("double"))
    rest = sent.join(kth, "query_id", "left").select(F.col("query_id").alias("vec_id"), "v", floor.alias("floor"), F.col("grp").alias("seen"))
    two = visit(store.kept(rest.mapInArrow(onward, ASK), "second-round"))
    return best(one.unionByName(two)).select("query_id", "rank", "vec_id", "score")
