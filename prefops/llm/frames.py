"""Running a function of texts over the rows of a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefops.llm import text as tx

TEXT = "__text"


#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, so that long texts don't make them as large as they come."""
    now = spark.conf.get(_LIMIT)
    if now.startswith("-") or int(re.sub(r"\D", "", now)) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(columns: Iterable[str], names: Iterable[str]) -> list[str]:
    """The columns that have none of the names, in upper or lower case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def map_texts(
    df: DataFrame,
    text: str,
    schema: str,
    make: Callable[[pa.Array], list[pa.Array]],
    keep: Iterable[str] | None = None,
    limit: int = tx.PIECE_BYTES,
) -> DataFrame:
    """The kept columns of df (default: all) and those that `make` gives for its texts.

    `make` gets some rows' texts and returns one array per column of `schema`.
    A column of df with the name of a new one gives way to it. Rows move through
    Python as Arrow; no column but the text is looked at.
    """
    bounded_batches(df.sparkSession)
    added = T.StructType.fromDDL(schema)
    kept = without(df.columns if keep is None else keep, added.fieldNames())
    source = df.select(*(F.col(quoted(c)) for c in kept), F.col(quoted(text)).cast("string").alias(TEXT))
    types = T.StructType([*(source.schema[c] for c in kept), *added.fields])
    names, n = types.fieldNames(), len(kept)

    def run(batches):
        for batch in batches:
            texts = batch.column(n)
            for lo, hi in tx.pieces(texts, limit):
                new = make(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(n)), *new], names)
        tx.release()

    return source.mapInArrow(run, types)


#: Up to so many keys (32 MB) are sent to every task as a list.
MOST_KEYS = 4_000_000
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def rows_of_keys(df: DataFrame, key: str, keys: DataFrame, inside: bool = True, most: int = MOST_KEYS) -> DataFrame:
    """The rows of df whose key is among those of the one column of `keys`, or those whose key isn't.

    Up to `most` integer keys go to the tasks as a sorted list, so that df, which
    may hold long texts, isn't moved. More keys, or others, are joined. A null key
    is among none. `keys` is read twice.
    """
    bounded_batches(df.sparkSession)
    name = keys.columns[0]
    keys = keys.where(F.col(quoted(name)).isNotNull()).distinct()
    if not isinstance(df.schema[key].dataType, _INTEGERS) or keys.count() > most:
        other = keys.select(F.col(quoted(name)).alias("__other"))
        return df.join(other, F.col(quoted(key)) == F.col("__other"), "left_semi" if inside else "left_anti")
    listed = np.sort(keys.select(F.col(quoted(name)).cast("long").alias("k")).toArrow()["k"].to_numpy())
    shared = df.sparkSession.sparkContext.broadcast(listed)
    at = df.columns.index(key)

    def run(batches):
        listed = shared.value
        for batch in batches:
            column = batch.column(at)
            k = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            found = np.zeros(len(k), bool)
            if len(listed):
                found = listed[np.minimum(np.searchsorted(listed, k), len(listed) - 1)] == k
                found &= np.asarray(column.is_valid())
            yield batch.filter(pa.array(found == inside))

    return df.mapInArrow(run, df.schema)
