"""Tensor files as tables: rows of one or more tensors with the same first dimension.

A file is the length of its header (8 bytes, little-endian), the header, which is
JSON with type, shape and place of every tensor, and the numbers, row by row. A
file is cut into ranges of rows and each task reads only its own bytes of the
tensors that are asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prefops.sources.stores import open_store, qualified

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 8 << 20

# Fixed values of the format: names of the number types, how the numbers lie in a
# file, and the column type. BF16 is the upper half of a 32-bit float.
TYPES = {
    "F64": ("<f8", T.DoubleType()),
    "F32": ("<f4", T.FloatType()),
    "F16": ("<f2", T.FloatType()),
    "BF16": ("<u2", T.FloatType()),
    "I64": ("<i8", T.LongType()),
    "I32": ("<i4", T.IntegerType()),
    "I16": ("<i2", T.ShortType()),
    "I8": ("i1", T.ByteType()),
    "U8": ("u1", T.ShortType()),
    "BOOL": ("?", T.BooleanType()),
}
NAMES = {"double": "F64", "float": "F32", "int64": "I64", "int32": "I32", "int16": "I16", "int8": "I8", "bool": "BOOL"}


@dataclass
class Tensor:
    name: str
    type: str
    shape: tuple[int, ...]
    at: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def row_bytes(self) -> int:
        return np.dtype(TYPES[self.type][0]).itemsize * self.width

    @property
    def column(self) -> T.DataType:
        return T.ArrayType(TYPES[self.type][1]) if len(self.shape) > 1 else TYPES[self.type][1]


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int
    tensors: list[Tensor]


def header(path: str, wanted: list[str]) -> list[Tensor]:
    """The tensors of a file, those in `wanted` in that order, or all by name."""
    store, name = open_store(path)
    with store.open_input_file(name) as f:
        size = int.from_bytes(f.read_at(8, 0), "little")
        if size > f.size() - 8:
            raise ValueError(f"{path}: no tensor file")
        entries = json.loads(f.read_at(size, 8))
    entries.pop("__metadata__", None)
    missing = [w for w in wanted if w not in entries]
    if missing:
        raise ValueError(f"{path}: no tensors {missing}; has {sorted(entries)}")
    found = []
    for n in wanted or sorted(entries):
        e = entries[n]
        if e["dtype"] not in TYPES or not 1 <= len(e["shape"]) <= 2:
            raise ValueError(f"{path}: {n} of type {e['dtype']} and shape {e['shape']} is no column")
        found.append(Tensor(n, e["dtype"], tuple(e["shape"]), 8 + size + e["data_offsets"][0]))
    if len({t.shape[0] for t in found}) > 1:
        raise ValueError(f"{path}: tensors differ in rows: {[(t.name, t.shape) for t in found]}")
    return found


def _column(raw: bytes, tensor: Tensor, n: int, nan_as_null: bool) -> pa.Array:
    values = np.frombuffer(raw, TYPES[tensor.type][0])
    if tensor.type == "BF16":
        values = (values.astype("<u4") << 16).view("<f4")
    elif tensor.type == "F16":
        values = values.astype("<f4")
    elif tensor.type == "U8":
        values = values.astype("<i2")
    flat = pa.array(values, from_pandas=nan_as_null)
    if len(tensor.shape) == 1:
        return flat
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype="<i4") * tensor.width, flat)


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.wanted = json.loads(options["tensors"])
        self.nan_as_null = set(json.loads(options["nan_as_null"]))
        self.split = int(options["split_bytes"])

    def partitions(self) -> list[Rows]:
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda p: header(p, self.wanted), self.paths))
        first = [(t.name, t.column, t.width) for t in headers[0]]
        parts = []
        for path, tensors in zip(self.paths, headers, strict=True):
            if [(t.name, t.column, t.width) for t in tensors] != first:
                raise ValueError(f"{path}: tensors differ from those of {self.paths[0]}")
            n = tensors[0].shape[0] if tensors else 0
            step = max(1, self.split // max(1, sum(t.row_bytes for t in tensors)))
            parts += [Rows(path, lo, min(n, lo + step), tensors) for lo in range(0, n, step)]
        return parts

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, name = open_store(part.path)
        step = max(1, BATCH_BYTES // max(1, sum(t.row_bytes for t in part.tensors)))
        with store.open_input_file(name) as f:
            for lo in range(part.start, part.stop, step):
                n = min(part.stop, lo + step) - lo
                columns = {"shard": pa.array([name.rsplit("/", 1)[-1]] * n), "row": pa.array(range(lo, lo + n), pa.int64())}
                for t in part.tensors:
                    raw = f.read_at(n * t.row_bytes, t.at + lo * t.row_bytes)
                    if len(raw) < n * t.row_bytes:
                        raise ValueError(f"{part.path}: ends within {t.name}")
                    columns[t.name] = _column(raw, t, n, t.name in self.nan_as_null)
                yield pa.RecordBatch.from_pydict(columns)


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prefops_tensors"

    def schema(self) -> T.StructType:
        tensors = header(json.loads(self.options["paths"])[0], json.loads(self.options["tensors"]))
        rows = T.StructType().add("shard", T.StringType()).add("row", T.LongType())
        for t in tensors:
            rows = rows.add(t.name, t.column)
        return rows

    def reader(self, schema: T.StructType) -> TensorReader:
        return TensorReader(self.options)


def read_tensors(
    spark: SparkSession,
    pattern: str,
    tensors: list[str] | None = None,
    nan_as_null: tuple[str, ...] = (),
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """All tensor files that match, in one table; an error when none does.

    Columns: `shard` (name of the file), `row` (place in it, from 0) and one per
    tensor, a number or an array by its dimensions. Only the bytes of `tensors`
    (default: all) are read, in ranges of `split_bytes`. In `nan_as_null` tensors
    NaN stands for an unknown value. Files without rows give none; files whose
    tensors differ are an error.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"no tensor files match {pattern}")
    paths = sorted(qualified(spark, f.getPath().toString()) for f in found)
    spark.dataSource.register(TensorSource)
    options = {"paths": json.dumps(paths), "tensors": json.dumps(tensors or []), "nan_as_null": json.dumps(list(nan_as_null))}
    return spark.read.format("prefops_tensors").options(**options, split_bytes=str(split_bytes)).load()


class TensorFile:
    """Rows gathered for one tensor file. The header holds the number of rows, so a file is held in memory until it is closed."""

    def __init__(self, schema: pa.Schema, most_bytes: int):
        self.schema, self.most, self.size, self.rows = schema, most_bytes, 0, 0
        self.parts: dict[str, list[np.ndarray]] = {f.name: [] for f in schema}
        self.width: dict[str, int] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        for field in self.schema:
            values = batch.column(field.name)
            if pa.types.is_list(field.type):
                lengths = set(values.value_lengths().to_pylist())
                lengths |= {self.width[field.name]} if field.name in self.width else set()
                if len(lengths) > 1 or None in lengths:
                    raise ValueError(f"rows of {field.name} differ in length: {sorted(map(str, lengths))}")
                self.width.update({field.name: w for w in lengths})
                values = values.flatten()
            if values.null_count and not pa.types.is_floating(values.type):
                raise ValueError(f"{field.name} has nulls, which {values.type} can't hold")
            numbers = values.to_numpy(zero_copy_only=False).astype(TYPES[_type_name(values.type)][0], copy=False)
            self.parts[field.name].append(numbers)
            self.size += numbers.nbytes
        self.rows += batch.num_rows
        if self.size > self.most:
            raise ValueError(f"a tensor file of over {self.most} bytes; write more shards")

    def save(self, out) -> None:
        entries, at = {}, 0
        for field in self.schema:
            size = sum(p.nbytes for p in self.parts[field.name])
            is_list = pa.types.is_list(field.type)
            shape = [self.rows, self.width.get(field.name, 0)] if is_list else [self.rows]
            kind = _type_name(field.type.value_type if is_list else field.type)
            entries[field.name] = {"dtype": kind, "shape": shape, "data_offsets": [at, at + size]}
            at += size
        head = json.dumps(entries).encode()
        head += b" " * (-len(head) % 8)
        out.write(len(head).to_bytes(8, "little") + head)
        for parts in self.parts.values():
            for p in parts:
                out.write(p.tobytes())


def _type_name(kind: pa.DataType) -> str:
    if str(kind) not in NAMES:
        raise ValueError(f"{kind} is no type of a tensor")
    return NAMES[str(kind)]
