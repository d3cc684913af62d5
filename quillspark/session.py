"""The package on the executors."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set = set()


@functools.lru_cache(maxsize=1)
def _archive() -> str:
    """This package's modules in a zip file that lasts as long as the driver."""
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quill-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "quillspark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(where, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application: its functions run there whether or not the
    cluster's Python path has it."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        _sent.add(sc.applicationId)
        sc.addPyFile(_archive())
    return spark
