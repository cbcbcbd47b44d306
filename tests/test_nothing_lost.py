"""Inputs that used to lose or mix rows without a word."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.operators import benchmark, fit, judge, ordering, packing, pairs, ranking
from prefops.plans import best_of_n
from prefops.sources import io

CONV = "array<struct<role:string,content:string>>"


def fails(df, said):
    with pytest.raises(Exception, match=said):
        df.collect()


def conversation(spark, *messages):
    return spark.createDataFrame([(list(messages),)], f"conv {CONV}")


def test_more_than_1024_answers(spark):
    rows = spark.range(1030).select(F.lit(1).alias("q_id"), F.col("id").cast("int").alias("ans_idx"), F.lit("p").alias("prompt"), F.lit("a").alias("answer"), F.lit(1).alias("label"))
    score = lambda df: df.withColumns({"plus": F.lit(1.0), "minus": F.lit(0.0)})
    assert best_of_n.step_scored(rows, score).count() == best_of_n.outcome_scored(rows, score).count() == 1030
    assert best_of_n.step_scored(rows, score, n=7).count() == 7


def test_answers_without_steps_stay(spark):
    rows = spark.createDataFrame([(1, 0, "p", None, 1), (1, 1, "p", "a", 0)], "q_id long, ans_idx int, prompt string, answer string, label int")
    got = best_of_n.step_scored(rows, lambda df: df.withColumns({"plus": F.lit(1.0), "minus": F.lit(0.0)}))
    assert {(r.ans_idx, r.score is None) for r in got.collect()} == {(0, True), (1, False)}
    steps = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, 0.25)], "q_id long, ans_idx int, step int, score double")
    r = best_of_n.question_records(rows, steps).first()
    assert (r.answers, r.label, r.step_scores) == ([None, "a"], [1, 0], [[], [0.5, 0.25]])


def test_a_tournament_has_one_winner(spark):
    rows = spark.createDataFrame([(q, i, i * 0.1, f"text {i}") for q in (1, 2) for i in range(5 + 4 * q)], "q_id long, ans_idx int, s double, answer string")
    better = lambda a, b: F.when(a["s"] > b["s"], 1.0).otherwise(0.0)
    whole = sorted(tuple(r) for r in ranking.tournament(rows, better).collect())
    narrow = sorted(tuple(r) for r in ranking.tournament(rows, better, columns=["s"]).select(rows.columns).collect())
    assert whole == narrow and [(r[0], r[1]) for r in whole] == [(1, 8), (2, 12)]


def test_vectors_of_unequal_length_or_with_nulls(spark):
    for vectors in ([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]], [[1.0, None], [1.0, 2.0]]):
        df = spark.createDataFrame([(v,) for v in vectors], "e array<double>").coalesce(1)
        fails(df.select(S.objective_rewards("e", np.eye(len(vectors[1])))), "one length is needed")


def test_messages_without_content_or_prefix(spark):
    fails(conversation(spark, ("user", None)).select(X.render_turns("conv")), "without content")
    fails(conversation(spark, ("user", None)).select(X.judge_prompt("conv", F.lit("a"), F.lit("b"))), "without content")
    fails(conversation(spark, ("tool", "x")).select(X.render_chat("conv", {"user": "U:"})), "without a prefix")
    assert conversation(spark, ("user", "x")).select(X.render_chat("conv", {"user": "U:"}).alias("t")).first().t == "U:x"


def test_unknown_subsets(spark):
    registry = benchmark.benchmark_registry(spark)
    name = K.BENCHMARK_SUBSETS[0][0]
    known = spark.createDataFrame([(name, 1.0), (name, None)], "subset string, correct double")
    assert {r.n for r in benchmark.subset_accuracy(known, registry).collect() if r.subset == name} == {1}
    strange = known.union(spark.createDataFrame([("no such", 1.0), (None, 1.0)], known.schema))
    fails(benchmark.subset_accuracy(strange, registry), "not in the registry")
    assert benchmark.unregistered(strange, registry).count() == 2


def test_one_stored_order_is_not_debiased(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.9), (2, 0.2)], "id long, prob_chosen double")
    got = {r.id: (r.chosen_prob, r.preference) for r in pairs.debiased_preference(df).collect()}
    assert got[1] == (None, None) and got[2][0] == pytest.approx(0.55)


def test_null_length(spark):
    with pytest.raises(Exception, match="without a length"):
        packing.pack_sequences(spark.createDataFrame([(1, 5), (2, None)], "id long, length long")).collect()


def test_repeated_keys(spark):
    df = spark.createDataFrame([(7,)] * 10, "id long")
    fails(ordering.shuffle_index(df, "id"), "key repeats")
    fails(ordering.train_val_split(df, "id"), "key repeats")


def test_newest_result_of_a_key_given_twice(spark):
    schema = "model string, split string, index long, said string"
    old = spark.createDataFrame([("m", "s", 1, "a")], schema)
    new = [("m", "s", 1, x) for x in "bdc"]
    for rows in (new, new[::-1]):
        assert [r.said for r in judge.merge_results(old, spark.createDataFrame(rows, schema)).collect()] == ["d"]


def test_nan_and_absent_labels(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], [nan, float(i) if i % 3 else nan]) for i in range(60)], "id long, embedding array<double>, labels array<double>")
    rows = fit.label_columns(df, ["a", "b"])
    assert rows.columns == ["id", "embedding", "a", "b"] and rows.where("a is null").count() == 60 and rows.where("b is null").count() == 20
    with_nan = df.select("id", "embedding", *(F.get("labels", F.lit(i)).alias(c) for i, c in enumerate("ab")))
    for frame in (rows, with_nan):
        probes = fit.fit_ridge_probe(frame, ["a", "b"])
        (r,) = probes.collect()
        assert r.attribute == "b" and math.isfinite(r.loss)
        with pytest.raises(ValueError, match=r"\[0\]"):
            fit.weight_matrix(probes, 2)
    fails(fit.label_columns(df, ["a"]), "not 1 labels")


def test_a_fit_keeps_the_partitions_of_its_scan(spark, tmp_path):
    spark.range(640).select("id", F.array(F.col("id").cast("double")).alias("embedding"), F.rand(1).alias("a")).repartition(64).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 30)
    try:
        df = spark.read.parquet(str(tmp_path / "t")).withColumn("is_val", F.col("id") % 5 == 0)
        assert fit.factor_partials(df, "embedding", ["a"], "is_val").rdd.getNumPartitions() >= 64
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scratch_folder_needs_a_name_where_there_are_executors(spark, monkeypatch):
    class Elsewhere:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        io.scratch_dir(Elsewhere)
