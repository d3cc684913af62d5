"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where=None) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of each class, chosen by a hash of their id, and
    how many rows of ``labels`` each class has. Rows without id or label, or with a label other than 0 and 1, are not
    used; of an id labelled twice the smallest label counts.

    Only chosen ids, at most 2 * per_class, are broadcast; every document is read, none is shuffled."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    count = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        one = rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id"), count
