"""Adding up the count vectors of all tasks, a slice at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.frames import bounded_batches

SLICES = 16
#: Counts are added over so many groups of tasks, then over the groups.
GROUPS = 64
_SCHEMA = "name string, slice int, grp int, counts binary"


def total_counts(df: DataFrame, size: int, count: Callable[[pa.RecordBatch, dict[str, np.ndarray]], None]) -> dict[str, np.ndarray]:
    """The sums, by name, of the vectors of `size` counts that `count` adds each batch of df to.

    The driver gets one number per name and count, whatever the data.
    """
    bounded_batches(df.sparkSession)
    width = -(-size // SLICES)
    columns = df.columns

    def each(batches):
        totals: dict[str, np.ndarray] = {}
        task = 0
        for batch in batches:
            task = int(batch.column(len(columns))[0].as_py()) if batch.num_rows else task
            count(batch, totals)
        tx.release()
        yield from _rows({(name, s, task % GROUPS): v[s * width : (s + 1) * width] for name, v in totals.items() for s in range(SLICES)})

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                sums[tuple(key)] = sums.get(tuple(key), 0) + np.frombuffer(counts, np.int64)
        yield from _rows(sums)

    parts = df.withColumn("__task", F.spark_partition_id()).mapInArrow(each, _SCHEMA)
    grouped = parts.repartition(SLICES, "name", "slice", "grp").mapInArrow(add, _SCHEMA)
    total = grouped.withColumn("grp", F.lit(0)).repartition(SLICES, "name", "slice").mapInArrow(add, _SCHEMA)
    out: dict[str, np.ndarray] = {}
    for row in total.collect():
        out.setdefault(row.name, np.zeros(size, np.int64))[row.slice * width : (row.slice + 1) * width] = np.frombuffer(row.counts, np.int64)
    return out


def _rows(sums: dict):
    if sums:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()),
                pa.array([np.asarray(sums[k], np.int64).tobytes() for k in keys], pa.binary()),
            ], ["name", "slice", "grp", "counts"],
        )
