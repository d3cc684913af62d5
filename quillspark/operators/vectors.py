"""Close vectors over whole tables, block against block: all pairs, or only whether a row has a close one.

Rows are dealt into blocks of about ``BLOCK`` by a hash of their id, and every two blocks meet in one group, so no pair is
left out and a task holds two blocks whatever the table's size. A matrix product finds pairs that can reach the bound;
their cosine is then summed component by component, as ``columns.cosine`` does. The work grows with the square of the
rows, and each block is sent once for every block.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
id; vectors of different lengths make no pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, rows multiplied at once, pairs made exact at once.
BLOCK, STRIP, CHUNK = 4096, 512, 65_536
#: What a product of unit vectors may miss by; far above its rounding.
SLACK = 1e-9


def _side(t: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and, one row for each component, the vectors of a side."""
    t = t.filter(pa.compute.equal(t["side"], side))
    v = t["v"].combine_chunks()
    return t["id"].to_numpy(), np.ascontiguousarray(v.flatten().to_numpy().reshape(len(t), -1).T) if len(t) else np.empty((0, 0))


def _dot(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for a, b in zip(x, y, strict=True):
        out += a[i] * b[j]
    return out


def cosine_pairs(df: DataFrame, least: float, ident: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """a, b, cosine: all pairs of rows with a < b whose cosine is ``least`` or more. Ids are whole numbers."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        (ia, x), (ib, y) = _side(t, 0), _side(t, 1)
        if t["p"][0] == t["q"][0]:
            ib, y = ia, x
        if not len(ia) or not len(ib):
            return
        every = np.arange(max(len(ia), len(ib)))
        nx, ny = _dot(x, every[: len(ia)], x, every[: len(ia)]), _dot(y, every[: len(ib)], y, every[: len(ib)])
        ux, uy = x / np.sqrt(nx), y / np.sqrt(ny)
        for s in range(0, len(ia), STRIP):
            i, j = np.nonzero(ux[:, s : s + STRIP].T @ uy >= least - SLACK)
            i += s
            keep = ia[i] < ib[j] if ib is ia else ia[i] != ib[j]
            i, j = i[keep], j[keep]
            for c in range(0, len(i), CHUNK):
                p, q = i[c : c + CHUNK], j[c : c + CHUNK]
                cos = _dot(x, p, y, q) / np.sqrt(nx[p] * ny[q])
                ok = cos >= least
                a, b = ia[p][ok], ib[q][ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cos[ok])], ["a", "b", "cosine"])

    v = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = df.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumns({"k": F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), "size": F.size("v")})
    met = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = met.select("size", F.least("k", "o").alias("p"), F.greatest("k", "o").alias("q"), (F.col("k") > F.col("o")).cast("int").alias("side"), "id", "v")
    return met.groupBy("size", "p", "q").applyInArrow(pairs, "a long, b long, cosine double")


#: Rows of a block where only rows, not pairs, come out.
WIDE = 8192


def _usable(v: str) -> tuple:
    """The column as doubles, and whether it can be compared."""
    numbers = F.transform(v, lambda c: c.cast("double"))
    fine = F.forall(numbers, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(numbers, lambda c: c != 0)
    return numbers, F.coalesce(fine, F.lit(False))


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    col = t[name].combine_chunks()
    return np.ascontiguousarray(col.flatten().to_numpy().reshape(len(t), -1).T)


def close_rows(df: DataFrame, others: DataFrame, keys: list[str], sides: list[str], least: float, apart: bool = False, block: int = WIDE) -> DataFrame:
    """The distinct keys of the rows of ``df`` for which some one row of ``others`` has a cosine of ``least`` or more in every one of the
    vector columns ``sides``; with ``apart`` (one key of whole numbers) a row with an equal key does not count. A task holds a block of
    either table, and at most its rows come out of it, so results grow with the rows and not with their pairs.

    Rows with a vector that is null, empty, zero or holds null or non-finite components are close to none, nor are
    vectors of different lengths."""
    def rows(t: DataFrame) -> DataFrame:
        made = [_usable(v) for v in sides]
        t = t.select(*keys, *(m.alias(f"v{k}") for k, (m, _) in enumerate(made)), *(ok.alias(f"ok{k}") for k, (_, ok) in enumerate(made)))
        for k in range(len(sides)):
            t = t.where(F.col(f"ok{k}"))
        return t.drop(*(f"ok{k}" for k in range(len(sides)))).withColumn("sizes", F.array(*(F.size(f"v{k}") for k in range(len(sides)))))

    def blocks(t: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-t.count() // block))
        return t.withColumn("own", F.pmod(F.xxhash64(*keys, F.col("v0")), F.lit(n)).cast("int")), n

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(len(left), bool)
        if len(left) and len(right):
            pairs = [(_matrix(left, f"v{k}"), _matrix(right, f"v{k}")) for k in range(len(sides))]
            norms = [(np.einsum("ij,ij->j", x, x) ** 0.5, np.einsum("ij,ij->j", y, y) ** 0.5) for x, y in pairs]
            same = [t[keys[0]].to_numpy() for t in (left, right)] if apart else None
            for s in range(0, len(left), STRIP):
                ok = sure = None
                for (x, y), (nx, ny) in zip(pairs, norms, strict=True):
                    c = (x[:, s : s + STRIP] / nx[s : s + STRIP]).T @ (y / ny)
                    near, far = c >= least - SLACK, c >= least + SLACK
                    ok, sure = (near, far) if ok is None else (ok & near, sure & far)
                if apart:
                    other = same[0][s : s + STRIP, None] != same[1][None, :]
                    ok, sure = ok & other, sure & other
                found = sure.any(1)
                # within rounding of the bound the sum is made component by component
                i, j = np.nonzero(ok & ~found[:, None])
                good = np.ones(len(i), bool)
                for x, y in pairs:
                    p, q = x[:, s + i], y[:, j]
                    d, a, b = (np.zeros(len(i)) for _ in range(3))
                    for u, v in zip(p, q, strict=True):
                        d, a, b = d + u * v, a + u * u, b + v * v
                    good &= d / np.sqrt(a * b) >= least
                found[i[good]] = True
                hit[s : s + STRIP] = found
        return left.select(keys).filter(pa.array(hit))

    (left, n), (right, m) = blocks(rows(df)), blocks(rows(others))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = right.withColumnRenamed("own", "other").withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    names = ["sizes", "own", "other"]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(meet, schema).distinct()
