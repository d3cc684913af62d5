"""Intermediate tables of the iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder (spark.checkpoint.dir; only where unset, a temporary one) that nothing has used; what is
    there when the driver ends is deleted."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="quill-")
        spark.sparkContext.setCheckpointDir(top)
    if not _made:
        atexit.register(_clean)
    path = f"{top.rstrip('/')}/step-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def once(df: DataFrame) -> DataFrame:
    """``df`` itself if ``kept`` gave it, else what ``kept`` gives."""
    return df if getattr(df, "_quill_path", None) in _made else kept(df)


def drop(df: DataFrame) -> None:
    """Deletes what ``kept`` wrote, once nothing reads it any more."""
    path = getattr(df, "_quill_path", None)
    if path in _made:
        _delete(_made.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session may be gone
            return
