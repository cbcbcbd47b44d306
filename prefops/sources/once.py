"""Appending a job's rows exactly once, under the names `job-00000-of-00004`.

Tasks write under a hidden folder and report what they wrote. Only when all have,
the driver gives the files their names and leaves a manifest. A job whose
manifest is there writes nothing; one that stopped before it, at whatever point,
replaces its own files. A lost or repeated task leaves files nobody reads.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from prefops.sources.stores import open_store, qualified
from prefops.sources.tensors import TensorFile

ENDINGS = {"parquet": "parquet", "tensors": "safetensors"}
MOST_BYTES = 1 << 30

# Characters that Spark writes as %XX in names of folders, and the folder of null.
ESCAPED = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: folder below the table, place below the hidden folder, rows."""

    task: int
    files: list[tuple[str, str, int]]


def _folder(names: list[str], values: tuple) -> str:
    text = (NULL_FOLDER if v in (None, "") else ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", str(v)) for v in values)
    return "/".join(f"{n}={t}" for n, t in zip(names, text, strict=True))


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Successive rows with equal values in `names`."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for n in names:
        codes = batch.column(n).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(change)
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        run = batch.slice(lo, hi - lo)
        yield tuple(run.column(n)[0].as_py() for n in names), run.drop_columns(names) if names else run


class OnceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.job, self.kind = options["path"], options["job"], options["kind"]
        self.names = json.loads(options["folders"])
        self.schema = T.StructType([f for f in schema if f.name not in self.names])

    def _open(self, store: fs.FileSystem, root: str, name: str):
        store.create_dir(f"{root}/_staged/{self.job}")
        out = store.open_output_stream(f"{root}/_staged/{self.job}/{name}")
        schema = to_arrow_schema(self.schema)
        return out, pq.ParquetWriter(out, schema) if self.kind == "parquet" else TensorFile(schema, MOST_BYTES)

    def _close(self, out, sink) -> None:
        if self.kind == "parquet":
            sink.close()
        else:
            sink.save(out)
        out.close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        task, files, opened, last = TaskContext.get().partitionId(), [], None, None
        schema = to_arrow_schema(self.schema)

        def begin(folder: str):
            name = f"{task}-{uuid.uuid4().hex}"
            files.append([folder, name, 0])
            return self._open(store, root, name)

        if not self.names:
            # A shard without rows is a file too.
            opened, last = begin(""), ()
        for batch in iterator:
            for values, run in _runs(batch, self.names):
                if values != last:
                    if opened:
                        self._close(*opened)
                    opened, last = begin(_folder(self.names, values)), values
                if self.kind == "parquet":
                    opened[1].write_table(pa.Table.from_batches([run]).cast(schema))
                else:
                    opened[1].add(run)
                files[-1][2] += run.num_rows
        if opened:
            self._close(*opened)
        return Written(task, [tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        store.create_dir(root)
        ending = ENDINGS[self.kind]
        mine = re.compile(rf"{re.escape(self.job)}-\d{{5,}}-of-\d{{5,}}\.{ending}")
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and mine.fullmatch(info.base_name):
                store.delete_file(info.path)
        by_folder = defaultdict(list)
        for m in sorted((m for m in messages if m), key=lambda m: m.task):
            for folder, name, rows in m.files:
                by_folder[folder].append((name, rows))
        listed = []
        for folder, files in sorted(by_folder.items()):
            where = f"{root}/{folder}".rstrip("/")
            store.create_dir(where)
            for i, (name, rows) in enumerate(files):
                final = f"{self.job}-{i:05d}-of-{len(files):05d}.{ending}"
                store.move(f"{root}/_staged/{self.job}/{name}", f"{where}/{final}")
                listed.append({"file": f"{folder}/{final}".lstrip("/"), "rows": rows})
        store.create_dir(f"{root}/_commits")
        new = f"{root}/_commits/.{self.job}-{uuid.uuid4().hex}"
        with store.open_output_stream(new) as out:
            out.write(json.dumps({"job": self.job, "files": listed}).encode())
        store.move(new, f"{root}/_commits/{self.job}.json")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        if store.get_file_info(f"{root}/_staged/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_staged/{self.job}")


class OnceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prefops_once"

    def writer(self, schema: T.StructType, overwrite: bool) -> OnceWriter:
        return OnceWriter(self.options, schema)


def manifest(spark: SparkSession, path: str, job: str) -> dict | None:
    """What a job has committed: its name and its files with their rows; None if it has not."""
    store, root = open_store(qualified(spark, path))
    name = f"{root}/_commits/{job}.json"
    if store.get_file_info(name).type != fs.FileType.File:
        return None
    with store.open_input_stream(name) as f:
        return json.loads(f.read())


def write_once(df: DataFrame, path: str, job: str, kind: str = "parquet", folders: tuple[str, ...] = ()) -> bool:
    """Append the rows of `job` to the table at `path` unless it has them already; whether it wrote.

    One file per task, or per task and value of `folders`. `kind` is parquet, or
    tensors for columns of numbers and of arrays of one length; a tensor file is
    held in memory and may have 1 GB. Jobs of different names may write at
    the same time, two runs of one name may not.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", job):
        raise ValueError(f"no name of a job: {job!r}")
    if kind not in ENDINGS:
        raise ValueError(f"kind {kind!r}; known are {sorted(ENDINGS)}")
    spark = df.sparkSession
    if manifest(spark, path, job):
        return False
    spark.dataSource.register(OnceSource)
    rows = df.sortWithinPartitions(*folders) if folders else df
    options = {"path": qualified(spark, path), "job": job, "kind": kind, "folders": json.dumps(list(folders))}
    rows.write.format("prefops_once").mode("append").options(**options).save()
    return True
