"""Token-ID output: ORC files with integer run-length encoding, row indexes and Bloom filters on document ids.

``write`` sorts documents by id over range partitions, so each ORC file holds one range of ids and its stripe and row
group statistics prune a search by id; the Bloom filters prune further. Files and stripes are read independently.
A row holds ``ord`` (file number in the high bits, row number in the low 33), ``doc_id`` and ``ids``.

Edge cases: a null text counts as empty and has only the end id; null ids sort first; rows that share an
id are kept, in one file by their texts and over several files by hashes of these; other columns are ignored; an empty table gives files without rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import store
from quillspark.llm import textvec as V
from quillspark.llm import tokens as T

FILE_SHIFT = 33
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def write(docs: DataFrame, path: str, tokenizer: str, *, drop_space: bool, end_id: int = 2, bytes_per_file: int = 16 << 20) -> None:
    """Writes the ids of every text, each followed by ``end_id``, in ascending order of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = store.buckets(store.text_bytes(docs), bytes_per_file)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = T.encoder(tokenizer, drop_space), TaskContext.get().partitionId() << FILE_SHIFT
        for b in batches:
            for lo, hi, data, off in V.chunks(b.column("text"), T.TOKEN_CHUNK):
                ids, size = enc.encode(data, off)
                upto = np.concatenate(([0], np.cumsum(size + 1)))
                out = np.empty(int(upto[-1]), np.int32)
                last = np.zeros(len(out), bool)
                last[upto[1:] - 1] = True
                out[last], out[~last] = end_id, ids
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(hi - lo)), b.column("doc_id").slice(lo, hi - lo), lists], ["ord", "doc_id", "ids"])
                row += hi - lo

    # rows that share an id, or have none, are spread over files by their texts
    ordered = docs.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "ord long, doc_id long, ids array<int>").write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ord long, doc_id long, ids array<int>").orc(path)


def digest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Count and crc32 of the ids of each row."""
    for b in batches:
        lists = b.column("ids")
        flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
        crcs = [T.crc(flat[x:y]) for x, y in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("doc_id"), pa.array(np.diff(off)), pa.array(crcs, pa.int64())], ["ord", "doc_id", "n_tokens", "ids_crc32"])


def summary(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ids_crc32 of every row that ``read`` returns.

    The sum before a row is the sum of the files before its file and of the rows before it in its file, so no task
    sees more than one file's rows; only one total for each file meets in one task."""
    rows = files.mapInArrow(digest, "ord long, doc_id long, n_tokens long, ids_crc32 long").withColumn("file", F.shiftright("ord", FILE_SHIFT))
    rows = store.kept(rows, "orc-digest")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("ord")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
