"""Row shapes shared by the operators, and the check made at their entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CONVERSATION = T.ArrayType(MESSAGE)

STANDARD_PAIR = T.StructType(
    [
        T.StructField("pair_id", T.LongType()),
        T.StructField("chosen", CONVERSATION),
        T.StructField("rejected", CONVERSATION),
    ]
)

JUDGEMENT = T.StructType(
    [
        T.StructField("split", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("preference_orig_order", T.StringType()),
        T.StructField("preference_swapped_order", T.StringType()),
        T.StructField("preference", T.IntegerType()),
        T.StructField("response_orig", T.StringType()),
        T.StructField("response_swapped", T.StringType()),
    ]
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Return `df`, or raise when one of `columns` is missing.

    Rows are matched by key and never by position, so an operator that needs a
    key column names it here.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
