"""Resumable labelling on a stream of raw judge answers.

A labelling run may stop and start again, skipping what it has. A stream reads
new answer files and keeps the key of every answer it has let through in keyed
state (RocksDB), so a micro-batch costs as much as its own answers, however
many results there are. Each batch writes to a folder named after it; a batch
that is run again after a failure starts from the state before it and
overwrites its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prefops.operators import judge
from prefops.schema import JUDGEMENT

ANSWERS = T.StructType(
    [JUDGEMENT[c] for c in ("split", "index", "model", "response_orig", "response_swapped")]
)
RESULTS = T.StructType([*JUDGEMENT.fields, T.StructField("batch_id", T.LongType())])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of all batches, one per key, the last one written."""
    rows = spark.read.schema(RESULTS).parquet(path)
    return judge.latest_results(rows, "batch_id").select(*JUDGEMENT.fieldNames())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_batch(fresh: DataFrame, batch_id: int, path: str) -> None:
    """Judge answers that have no result yet and write them as the results of one batch."""
    judge.judge_rows(fresh).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def label_batch(answers: DataFrame, batch_id: int, path: str) -> None:
    """Judge those answers that no earlier batch under `path` has judged, for callers without a stream.

    Earlier results are read, so the cost grows with them; a stream keeps their keys instead.
    """
    spark = answers.sparkSession
    # Of answers to one question in one batch, always the same one.
    one = F.max(F.struct("response_orig", "response_swapped")).alias("_a")
    fresh = answers.groupBy(*judge.RESULT_KEYS).agg(one).select(*judge.RESULT_KEYS, "_a.*")
    if _exists(spark, path):
        done = spark.read.schema(RESULTS).parquet(path).where(F.col("batch_id") < batch_id)
        fresh = judge.pending(fresh, done)
    write_batch(fresh, batch_id, path)


def _stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for the stream, so that the caller's settings stay as they are."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def label_stream(
    spark: SparkSession,
    answers_path: str,
    results_path: str,
    checkpoint: str,
    format: str = "parquet",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Label every answer file that is there and end; call again, with the same checkpoint, when there are more.

    The answer to a question that arrives first is judged, and of several that
    arrive in one batch any one. State holds one row per key and no answer. It
    is dealt by key over as many partitions as the first run has shuffle
    partitions, which cannot change later.
    """
    reader = _stateful_session(spark).readStream.schema(ANSWERS).format(format)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    fresh = reader.load(answers_path).dropDuplicates(judge.RESULT_KEYS)
    return (
        fresh.writeStream.foreachBatch(lambda df, n: write_batch(df, n, results_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
