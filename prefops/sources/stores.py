"""Files opened by Python tasks, on any store that pyarrow knows."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark would take it: a bare path lies on the cluster's default store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(hadoop).toString()


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path, and the path within it."""
    local = re.match(r"file:/+", path)
    if local or ":/" not in path:
        return fs.LocalFileSystem(), "/" + path[local.end() :] if local else path
    return fs.FileSystem.from_uri(path)
