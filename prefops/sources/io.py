"""Reading and writing tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefops.schema import JUDGEMENT, require
from prefops.sources.once import write_once


# Quotes are doubled, blanks kept and empty texts written out, so that any text
# comes back as it was.
CSV_TEXT = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a folder of this machine is named, but only if the driver
    is the only process that there is; `local-cluster` has others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"prefops-{application}-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read it back.

    For a frame that is costly to make and read several times with few columns:
    a columnar table gives each reader only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_split(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    source: str | None = None,
    format: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A table, optionally only one split and one source; both filters reach the scan."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    if format == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    for name, value in (("split", split), ("source", source)):
        if value is not None:
            df = require(df, name).where(F.col(name) == value)
    return df


def read_shards(spark: SparkSession, pattern: str, format: str = "parquet", merge_schema: bool = False) -> DataFrame:
    """All shard files that match, as one table; an error when none does."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"no shards match {pattern}")
    return spark.read.format(format).option("mergeSchema", merge_schema).load(pattern)


def write_shards(
    df: DataFrame, path: str, n: int, key: str | None = None, mode: str = "errorifexists", name: str | None = None, kind: str = "parquet"
) -> None:
    """n files of about the same size; with a unique `key`, a row's file depends on its key only.

    With a `name` the files are called `name-00000-of-00004` and written once
    (`once.write_once`, which also knows the `kind` tensors): again they are left as they are.
    """
    spread_rows = df.repartition(n) if key is None else df.repartition(n, key)
    if name is not None:
        write_once(spread_rows, path, name, kind)
    else:
        spread_rows.write.mode(mode).format(kind).save(path)


def write_judgements(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "append", job: str | None = None
) -> None:
    """Result rows in one folder per model and split.

    The rebalance hint brings the rows of a folder together and splits those of
    a model that has very many over several tasks. A named `job`, which writes
    Parquet, adds its rows once however often it runs; without a name a repeated
    append repeats them.
    """
    require(df, *JUDGEMENT.fieldNames())
    rows = df.select(*JUDGEMENT.fieldNames()).hint("rebalance", "model", "split")
    if job is not None:
        if format != "parquet" or mode != "append":
            raise ValueError("a named job appends Parquet")
        write_once(rows, path, job, folders=("model", "split"))
        return
    writer = rows.write.mode(mode).partitionBy("model", "split").format(format)
    if format == "csv":
        writer = writer.options(**CSV_TEXT, quoteAll=True)
    writer.save(path)


def read_judgements(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Result rows as written by `write_judgements`."""
    reader = spark.read.schema(JUDGEMENT).format(format)
    if format == "csv":
        reader = reader.options(**CSV_TEXT, multiLine=True, nullValue="\0")
    return reader.load(path).select(*JUDGEMENT.fieldNames())


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_record(df: DataFrame, path: str, model: str | Column, job: str | None = None) -> None:
    """Append section scores of a model: (model, section, score); those of a named `job` once however often it runs."""
    require(df, "section", "score")
    name = F.lit(model) if isinstance(model, str) else model
    # A report has one row per section, so it is one file.
    rows = df.select(name.alias("model"), "section", F.col("score").cast("double")).coalesce(1)
    if job is not None:
        write_once(rows, path, job)
    else:
        rows.write.mode("append").parquet(path)
