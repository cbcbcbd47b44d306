"""Running a user's model over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from prefops.schema import require


def score_batches(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    in_cols: list[str],
    out_schema: str,
    batch: int = 64,
    length: str | None = None,
) -> DataFrame:
    """Add the columns a model computes from `in_cols`.

    `load` runs once per task and returns the scoring function, which maps a
    frame of at most `batch` rows to a frame of `out_schema` with as many rows.
    Scores are kept as the model gives them; all other columns pass through as
    they are. `length` names a column to sort by inside each partition, so that
    a batch holds texts of one size.
    """
    require(df, *in_cols, *([length] if length else []))
    added = T.StructType.fromDDL(out_schema)
    schema = T.StructType(df.schema.fields + added.fields)
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                scored = score(part.select(in_cols).to_pandas())
                if len(scored) != part.num_rows:
                    raise ValueError(f"{len(scored)} scores for {part.num_rows} rows")
                new = [pa.Array.from_pandas(scored[f.name], type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *arrow.names])

    rows = df.sortWithinPartitions(F.col(length)) if length else df
    return rows.mapInArrow(run, schema)
