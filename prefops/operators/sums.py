"""Sums of vectors over tasks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums of tasks are added in so many groups, and then over the groups.
GROUPS = 64


def added(parts: DataFrame, *by: str) -> DataFrame:
    """Sums of the vectors `v` by key, over groups of tasks first, so that no task adds those of all tasks."""
    total = Summarizer.sum(F.col("v")).alias("v")
    grouped = parts.withColumns({"v": array_to_vector("v"), "_group": F.spark_partition_id() % GROUPS}).groupBy(*by, "_group").agg(total)
    return grouped.groupBy(*by).agg(total).select(*by, vector_to_array("v").alias("v"))
