import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prefops.operators import judge, packing, scoring
from prefops.schema import JUDGEMENT
from prefops.sources import io
from prefops.streaming import labelling


def names(df):
    return sorted(r["model"] for r in df.collect())


def test_usable_models(spark):
    registry = judge.judge_models(spark)
    assert registry.count() == 41
    small = judge.usable_models(registry, max_size=8)
    assert names(small) == ["Llama-3.2-3B", "Mistral-7B-v0.1", "Mistral-7B-v0.2", "Mistral-7B-v0.3", "Qwen-2.5-7B"]
    assert judge.usable_models(registry, "gemini").count() == 5
    asked = ["Llama-3-8B", "Gemma-2B", "GPT-4o", "nobody"]
    assert names(judge.usable_models(registry, names=asked)) == ["Llama-3-8B"]


@pytest.mark.parametrize(
    ("model", "size", "why"), [("nobody", None, "unknown"), ("GPT-4o", None, "vendor"), ("Llama-3-8B", 8, "not below")]
)
def test_strict_models(spark, model, size, why):
    with pytest.raises(ValueError, match=why):
        judge.usable_models(judge.judge_models(spark), max_size=size, names=[model], strict=True)


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "split string, index long, model string, response_orig string, response_swapped string"
    )


def test_judge_rows(spark):
    df = raw(
        spark,
        [
            ("val", 1, "m", "B is", "A is"),
            ("val", 2, "m", " A is\n", "b "),
            ("val", 3, "m", "API-ERROR", "A is"),
            ("val", 4, "m", "A", "A"),
        ],
    )
    got = {r["index"]: r for r in judge.judge_rows(df).collect()}
    assert [got[i]["preference"] for i in (1, 2, 3, 4)] == [1, -1, 0, 0]
    assert got[2]["response_orig"] == "A is"
    assert (got[3]["response_orig"], got[3]["response_swapped"]) == ("API-ERROR", "API-ERROR")
    assert got[3]["preference_swapped_order"] == "A"
    summary = judge.judge_summary(judge.judge_rows(df)).first()
    assert summary["position_bias"] == pytest.approx(1 / 3)


def test_pending_and_merge(spark):
    old = judge.judge_rows(raw(spark, [("val", i, "m", "A", "B") for i in (3, 1)]))
    new = judge.judge_rows(raw(spark, [("val", i, "m", "B", "A") for i in (2, 3)]))
    todo = spark.createDataFrame([("val", i, "m") for i in range(1, 5)], "split string, index long, model string")
    assert sorted(r["index"] for r in judge.pending(todo, old).collect()) == [2, 4]
    merged = judge.merge_results(old, new).collect()
    assert [(r["index"], r["preference"]) for r in merged] == [(1, -1), (2, 1), (3, 1)]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_judgements_come_back_as_they_were(spark, tmp_path, format):
    texts = ['a "quoted", text', "two\nlines", "", "back\\slash", " blank ", "A"]
    rows = [("train", i, "m", "A", "B", -1, t, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, JUDGEMENT)
    io.write_judgements(df, str(tmp_path / "j"), format)
    back = io.read_judgements(spark, str(tmp_path / "j"), format).orderBy("index")
    assert [tuple(r) for r in back.collect()] == rows


def test_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    io.write_shards(spark.range(1000), path, 4, "id")
    assert len(list((tmp_path / "shards").glob("part-*"))) == 4
    assert io.read_shards(spark, path + "/part-*").count() == 1000
    with pytest.raises(FileNotFoundError):
        io.read_shards(spark, str(tmp_path / "none*"))


def test_split_and_source_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "train", "x"), (2, "val", "x"), (3, "val", "y")]
    spark.createDataFrame(rows, "id int, split string, source string").write.parquet(path)
    df = io.read_split(spark, path, "val", "x").select("id")
    assert [r["id"] for r in df.collect()] == [2]
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(split,val)" in plan and "EqualTo(source,x)" in plan


def test_records_append(spark, tmp_path):
    path = str(tmp_path / "r")
    for model, score in (("a", 1.0), ("b", 2.0)):
        io.append_record(spark.createDataFrame([("Chat", score)], "section string, score double"), path, model)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "Chat", 1.0), ("b", "Chat", 2.0)]


def test_scratch_uses_the_named_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert io.scratch_path(spark, "x").startswith(shared)


def test_score_batches(spark):
    def load():
        def score(frame):
            assert len(frame) <= 7
            return frame.assign(n=frame["t"].str.len(), twice=frame["t"] + frame["t"])

        return score

    df = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(100)], "id int, t string")
    out = scoring.score_batches(df, load, ["t"], "n long, twice string", batch=7, length=None)
    assert out.columns == ["id", "t", "n", "twice"]
    assert all(r["n"] == len(r["t"]) and r["twice"] == r["t"] * 2 for r in out.collect())
    assert out.count() == 100


def test_score_batches_leaves_other_columns_alone(spark):
    big = 2**62 + 1
    rows = [(big, None, ["a"]), (None, 1.5, None)]
    df = spark.createDataFrame(rows, "id long, x double, tags array<string>").coalesce(1)
    out = scoring.score_batches(df, lambda: lambda f: f.assign(p=[0.5, None]), ["x"], "p double")
    assert [tuple(r) for r in out.collect()] == [(*rows[0], 0.5), (*rows[1], None)]


def test_score_batches_needs_a_score_per_row(spark):
    df = spark.range(10)
    short = scoring.score_batches(df, lambda: lambda f: f.head(1).rename(columns={"id": "n"}), ["id"], "n long")
    with pytest.raises(Exception, match="1 scores for 10 rows|scores for"):
        short.collect()


@pytest.mark.parametrize("per_bucket", [3, 50, 10_000])
def test_packing(spark, per_bucket):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 900 + 1).cast("int").alias("length"))
    df = df.union(spark.createDataFrame([(5000, 3000), (5001, 0), (5002, 0), (5003, 4000)], "id long, length int"))
    placed = packing.pack_sequences(df, block=1024, rows_per_bucket=per_bucket).collect()
    assert sorted(r["id"] for r in placed) == [*range(1000), 5000, 5001, 5002, 5003]
    blocks = {}
    for r in placed:
        blocks.setdefault(r["block"], []).append((r["offset"], r["length"]))
    for rows in blocks.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 1024 or len(rows) == 1
    used = sum(n for rows in blocks.values() for _, n in rows if n <= 1024)
    assert len(blocks) < 1.01 * used / 1024 + 3
    assert sorted(blocks) == list(range(len(blocks)))


def best_fit(lengths, block):
    """Blocks that best fit needs, longest first, row by row."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append(min(fitting, default=block) - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_blocks_planned_on_counts_are_those_of_best_fit(seed):
    rng = random.Random(seed)
    block = rng.choice([1, 7, 20, 64])
    lengths = [rng.randint(1, block) for _ in range(rng.choice([1, 30, 400]))] + [max(1, block // 3)] * rng.choice([0, 100])
    plan = packing.plan_blocks(Counter(lengths), block)
    fill, rows = Counter(), 0
    for size, runs in plan.items():
        ends = [start for start, *_ in runs[1:]] + [Counter(lengths)[size]]
        for (start, first, each, used), end in zip(runs, ends):
            for at in range(end - start):
                number = first + at // each
                assert fill[number] == used + at % each * size
                fill[number] += size
                rows += 1
    assert rows == len(lengths) and max(fill.values()) <= block
    assert len(fill) == best_fit(lengths, block)


def test_plan_of_a_hundred_billion_rows_is_small():
    counts = {n: 10**11 // n + n % 13 for n in range(1, 4097)}
    plan = packing.plan_blocks(counts, 4096)
    assert sum(map(len, plan.values())) < 40_000


def test_packing_without_rows_and_with_empty_rows_only(spark):
    assert packing.pack_sequences(spark.createDataFrame([], "id long, length int")).count() == 0
    rows = packing.pack_sequences(spark.createDataFrame([(1, 0), (2, 0)], "id long, length int"), block=8).collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_packing_runs_without_python(spark):
    df = spark.range(10).select("id", F.col("id").alias("length"))
    plan = packing.pack_sequences(df, block=16)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_label_stream_resumes_and_survives_a_repeated_batch(spark, tmp_path):
    answers, results, state = (str(tmp_path / x) for x in ("answers", "results", "state"))
    raw(spark, [("val", i, "m", "B", "A") for i in range(5)]).coalesce(1).write.mode("append").parquet(answers)
    labelling.label_stream(spark, answers, results, state).awaitTermination(120)
    assert labelling.read_results(spark, results).count() == 5
    more = raw(spark, [("val", i, "m", "A", "B") for i in range(3, 8)])
    more.coalesce(1).write.mode("append").parquet(answers)
    labelling.label_stream(spark, answers, results, state).awaitTermination(120)
    got = {r["index"]: r["preference"] for r in labelling.read_results(spark, results).collect()}
    assert got == {**{i: 1 for i in range(5)}, **{i: -1 for i in range(5, 8)}}
    labelling.label_batch(more, 1, results)
    again = {r["index"]: r["preference"] for r in labelling.read_results(spark, results).collect()}
    assert again == got


def test_cost_of_a_batch_does_not_grow_with_the_batches(spark, tmp_path):
    """50 batches of 4 answers, two of them new: each reads its own file, and state has the keys only."""
    answers, results, state = (str(tmp_path / x) for x in ("answers", "results", "state"))
    one_key = spark.newSession()
    one_key.conf.set("spark.sql.shuffle.partitions", "2")
    rows = [("val", 2 * n + i, "m", "B" if i > 1 else "A", "A" if i > 1 else "B") for n in range(50) for i in range(4)]
    for n in range(50):
        raw(spark, rows[4 * n : 4 * n + 4]).coalesce(1).write.mode("append").parquet(answers)
    query = labelling.label_stream(one_key, answers, results, state, files_per_batch=1)
    query.awaitTermination(300)
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in progress] == [4] * 50
    kept = [p["stateOperators"][0] for p in progress]
    assert [k["numRowsUpdated"] for k in kept] == [4] + [2] * 49
    assert kept[-1]["numRowsTotal"] == 102
    assert any("rocksdb" in name for name in kept[-1]["customMetrics"])
    labelled = labelling.read_results(spark, results)
    assert labelled.count() == labelled.select("index").distinct().count() == 102
    assert spark.read.parquet(results).count() == 102
    again = labelling.label_stream(one_key, answers, results, state)
    again.awaitTermination(120)
    assert spark.read.parquet(results).count() == 102
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").count("RocksDB") == 0
