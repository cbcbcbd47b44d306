import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefops.operators import judge
from prefops.plans import best_of_n
from prefops.schema import JUDGEMENT
from prefops.sources import io, once, tensors


def tensor_file(path, arrays, types=None):
    """A tensor file made by hand; BF16 numbers are given as their upper 16 bits."""
    names = {"float32": "F32", "float64": "F64", "int64": "I64", "uint16": "BF16", "float16": "F16", "uint8": "U8", "bool": "BOOL"}
    entries, at = {"__metadata__": {"format": "pt"}}, 0
    for name, a in arrays.items():
        entries[name] = {"dtype": (types or {}).get(name, names[str(a.dtype)]), "shape": list(a.shape), "data_offsets": [at, at + a.nbytes]}
        at += a.nbytes
    head = json.dumps(entries).encode()
    path.write_bytes(len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays.values()))


def half(a):
    return (a.astype("<f4").view("<u4") >> 16).astype("<u2")


@pytest.mark.parametrize("split_bytes", [1, 1000, 1 << 20])
def test_shards_of_another_writer(spark, tmp_path, split_bytes):
    rng = np.random.default_rng(1)
    want = {}
    for i, n in enumerate((50, 0, 7)):
        emb = half(rng.normal(size=(n, 12)))
        labels = rng.normal(size=(n, 3)).astype("<f4")
        labels[rng.random((n, 3)) < 0.3] = np.nan
        tensor_file(tmp_path / f"d-{i + 1:05d}-of-00003.safetensors", {"embeddings": emb, "labels": labels, "unused": np.zeros((n, 1000))})
        for r in range(n):
            want[f"d-{i + 1:05d}-of-00003.safetensors", r] = ((emb[r].astype("<u4") << 16).view("<f4").tolist(), labels[r])
    df = tensors.read_tensors(spark, f"{tmp_path}/d-*.safetensors", ["embeddings", "labels"], ("labels",), split_bytes)
    assert df.columns == ["shard", "row", "embeddings", "labels"]
    assert df.rdd.getNumPartitions() == {1: 57, 1000: 3, 1 << 20: 2}[split_bytes]
    got = {(r["shard"], r["row"]): r for r in df.collect()}
    assert set(got) == set(want)
    for k, (emb, labels) in want.items():
        assert got[k]["embeddings"] == emb
        assert got[k]["labels"] == [None if np.isnan(x) else float(x) for x in labels]


def test_types_and_dimensions(spark, tmp_path):
    arrays = {
        "a": np.array([1.5, np.nan], "float16"),
        "b": np.array([True, False]),
        "c": np.array([[1], [255]], "uint8"),
        "d": np.array([-1, 1 << 40], "int64"),
        "e": np.zeros((2, 0), "float64"),
    }
    tensor_file(tmp_path / "x.safetensors", arrays)
    rows = tensors.read_tensors(spark, f"{tmp_path}/x.safetensors").drop("shard").orderBy("row").collect()
    assert tuple(rows[0]) == (0, 1.5, True, [1], -1, [])
    assert np.isnan(rows[1]["a"]) and tuple(rows[1])[2:] == (False, [255], 1 << 40, [])


def test_files_that_are_no_table(spark, tmp_path):
    def read(name, **more):
        return tensors.read_tensors(spark, f"{tmp_path}/{name}", **more).collect()

    with pytest.raises(FileNotFoundError):
        read("none*")
    tensor_file(tmp_path / "uneven", {"a": np.zeros(2), "b": np.zeros(3)})
    tensor_file(tmp_path / "cube", {"a": np.zeros((2, 2, 2))})
    tensor_file(tmp_path / "other", {"a": np.zeros(2)})
    (tmp_path / "short").write_bytes((tmp_path / "other").read_bytes()[:-3])
    (tmp_path / "text").write_text("certainly no tensor file")
    for name, why in (("uneven", "differ in rows"), ("cube", "no column"), ("short", "ends within"), ("text", "no tensor file")):
        with pytest.raises(Exception, match=why):
            read(name)
    with pytest.raises(Exception, match="no tensors"):
        read("other", tensors=["z"])
    tensor_file(tmp_path / "w-1", {"a": np.zeros((2, 2))})
    tensor_file(tmp_path / "w-2", {"a": np.zeros((2, 3))})
    with pytest.raises(Exception, match="differ from those"):
        read("w-*")


def test_tensor_shards_round_trip(spark, tmp_path):
    rows = spark.range(100).select("id", F.array(F.col("id") / 7, F.lit(None).cast("double")).alias("v"), (F.col("id") % 2 == 0).alias("even"))
    for _ in range(2):
        io.write_shards(rows, str(tmp_path / "t"), 3, "id", name="part", kind="tensors")
    assert sorted(p.name for p in (tmp_path / "t").glob("[!_]*")) == [f"part-{i:05d}-of-00003.safetensors" for i in range(3)]
    back = tensors.read_tensors(spark, f"{tmp_path}/t/part-*", ["id", "v", "even"], ("v",)).drop("shard", "row")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    for bad, why in ((F.array_repeat(F.lit(1.0), F.col("id").cast("int")), "differ in length"), (F.lit("x"), "no type of a tensor"), (F.nullif("id", F.lit(3)), "nulls")):
        with pytest.raises(Exception, match=why):
            once.write_once(spark.range(9).coalesce(1).select(bad.alias("v")), str(tmp_path / "bad"), "job", "tensors")
        assert not list((tmp_path / "bad").glob("*.safetensors"))


def test_a_job_is_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100)
    assert once.write_once(rows.repartition(4), path, "a") and once.write_once(rows.repartition(2), path, "a.b")
    assert not once.write_once(rows.repartition(3), path, "a")
    assert sorted(p.name for p in (tmp_path / "t").glob("*.parquet")) == [f"a-{i:05d}-of-00004.parquet" for i in range(4)] + [
        f"a.b-{i:05d}-of-00002.parquet" for i in range(2)
    ]
    assert spark.read.parquet(path).count() == 200
    assert sum(f["rows"] for f in once.manifest(spark, path, "a")["files"]) == 100
    # The driver was lost before the manifest: the job replaces its own files, and no others.
    (tmp_path / "t" / "_commits" / "a.json").unlink()
    assert once.write_once(rows.repartition(3), path, "a")
    assert spark.read.parquet(path).count() == 200
    for name in ("", "_a", "a/b", "../a"):
        with pytest.raises(ValueError):
            once.write_once(rows, path, name)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    broken = spark.range(100).repartition(4, "id").select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error("lost").cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        once.write_once(broken, path, "a")
    assert not list((tmp_path / "t").rglob("*.parquet")) and once.manifest(spark, path, "a") is None
    assert once.write_once(spark.range(100), path, "a")
    assert spark.read.parquet(path).count() == 100


def test_folders_are_those_of_spark(spark, tmp_path):
    odd = ["plain", "a/b", "x=y", "50%", "é ü", "", None, "q'\"", "[z]"]
    rows = spark.createDataFrame([(m, s, i) for i, m in enumerate(odd) for s in ("train", "val")], "model string, split string, i int")
    once.write_once(rows.repartition(3), str(tmp_path / "once"), "a", folders=("model", "split"))
    rows.write.partitionBy("model", "split").parquet(str(tmp_path / "spark"))
    schema = "i int, model string, split string"
    got, want = (sorted(map(repr, spark.read.schema(schema).parquet(str(tmp_path / n)).collect())) for n in ("once", "spark"))
    assert got == want
    folders = [{p.parent.relative_to(tmp_path / n).as_posix() for p in (tmp_path / n).rglob("*.parquet")} for n in ("once", "spark")]
    assert folders[0] == folders[1]


def test_repeated_jobs_of_the_sinks(spark, tmp_path):
    judged = spark.createDataFrame([("train", i, m, "A", "B", -1, "x", None) for i in range(5) for m in "pq"], JUDGEMENT)
    record = spark.createDataFrame([("Chat", 1.0)], "section string, score double")
    scored = spark.createDataFrame([(1, 0, 0.5, 1), (1, 1, 0.2, 0)], "q_id long, ans_idx int, score double, label int")
    for _ in range(2):
        io.write_judgements(judged, str(tmp_path / "j"), job="one")
        io.append_record(record, str(tmp_path / "r"), "m", job="one")
        best_of_n.write_accuracy(scored, str(tmp_path / "a"), "steps", job="one")
    back = io.read_judgements(spark, str(tmp_path / "j"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, judged.collect()))
    assert judge.pending(judged, back).count() == 0
    assert spark.read.parquet(str(tmp_path / "r")).count() == spark.read.parquet(str(tmp_path / "a")).count() == 1
    with pytest.raises(ValueError):
        io.write_judgements(judged, str(tmp_path / "j"), "csv", job="two")


def test_empty_tables(spark, tmp_path):
    once.write_once(spark.range(0), str(tmp_path / "e"), "a")
    assert spark.read.schema("id long").parquet(str(tmp_path / "e")).count() == 0
    assert not once.write_once(spark.range(5), str(tmp_path / "e"), "a")
