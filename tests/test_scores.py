import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.operators import benchmark, ranking, ranks, stats, steps

RNG = np.random.default_rng(0)


def test_softmax_pair_at_large_logits(spark):
    rows = [(1000.0, -1000.0), (-1000.0, 1000.0), (3.0, 3.0), (1e308, -1e308)]
    got = spark.createDataFrame(rows, "a double, b double").select(S.softmax_pair("a", "b").alias("p")).collect()
    assert [r["p"] for r in got] == [1.0, 0.0, 0.5, 1.0]


def test_preference_is_a_half_only_at_a_half(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.4,)], "p double")
    assert [r[0] for r in df.select(S.preference_from_prob("p")).collect()] == [0.5, 1.0, 0.0]


def test_opposite_margins_tie(spark):
    """σ(x) + σ(-x) may miss 1 by a rounding error; the margins do not."""
    rows = [(i / 64, 0.0, i / 64, 0.0) for i in range(-500, 500)]
    df = spark.createDataFrame(rows, "a1 double, b1 double, a2 double, b2 double")
    got = df.select(S.preference_from_logits("a1", "b1", "a2", "b2").alias("p")).distinct().collect()
    assert [r["p"] for r in got] == [0.5]


def test_pair_outcome(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (None, 1.0)], "c double, r double")
    got = df.select(S.pair_outcome("c", "r").alias("half"), S.pair_outcome("c", "r", "lose").alias("lose")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 0.0), (0.5, 0.0), (None, None)]
    with pytest.raises(ValueError):
        S.pair_outcome("c", "r", "win")


def test_rewards_and_gates_match_numpy(spark):
    x, w = RNG.normal(size=(20, 6)), RNG.normal(size=(4, 6))
    w1, b1, w2, b2 = RNG.normal(size=(5, 6)), RNG.normal(size=5), RNG.normal(size=(4, 5)), RNG.normal(size=4)
    rows = [(i, [float(v) for v in x[i]]) for i in range(20)] + [(20, None)]
    df = spark.createDataFrame(rows, "id int, e array<float>").repartition(3)
    out = df.select(
        "id",
        S.objective_rewards("e", w).alias("r"),
        S.gate_weights("e", [(w1, b1), (w2, b2)], 10, 2.0).alias("g"),
    ).orderBy("id")
    got = out.collect()
    assert got[20]["r"] is None and got[20]["g"] is None
    x32 = x.astype(np.float32).astype(float)
    np.testing.assert_allclose([r["r"] for r in got[:20]], x32 @ w.T, atol=1e-9)
    z = (np.maximum(x32 @ w1.T + b1, 0) @ w2.T + b2) / 10
    want = 2 * np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    np.testing.assert_allclose([r["g"] for r in got[:20]], want, atol=1e-9)


def test_mixture_with_folded_penalties_equals_debiased_rewards(spark):
    r, g, pen = RNG.normal(size=19), RNG.dirichlet(np.ones(19)), RNG.uniform(size=19)
    pen[K.VERBOSITY_DIM] = 1.0
    df = spark.createDataFrame([(r.tolist(), g.tolist())], "r array<double>, g array<double>")
    direct = S.dot(S.verbosity_transform("r", pen), "g")
    folded = S.mixture_score("r", "g", pen)
    raw = S.mixture_score("r", "g")
    zero = F.get(S.verbosity_transform("r", pen), F.lit(K.VERBOSITY_DIM))
    a, b, c, d = df.select(direct, folded, raw, zero).first()
    assert a == pytest.approx(b) and c == pytest.approx(float(r @ g)) and d == 0.0


def test_top_objectives(spark):
    coeffs = [0.01] * 19
    coeffs[14], coeffs[4], coeffs[6] = 0.19922, -0.10864, 0.07861
    (best,) = spark.createDataFrame([(coeffs,)], "c array<double>").select(S.top_objectives("c")).first()
    assert [(o["name"], o["coeff"]) for o in best] == [
        ("code-complexity", 0.19922),
        ("helpsteer-verbosity", -0.10864),
        ("ultrafeedback-instruction_following", 0.07861),
    ]


def test_denormalize(spark):
    want = [2.78125, 2.859375, 3.484375, 1.3847656, 1.296875]
    rewards = [(v + 0.5) / 5 for v in want] + [9.0]
    (got,) = spark.createDataFrame([(rewards,)], "r array<double>").select(S.denormalize("r")).first()
    assert got == pytest.approx(want)


def test_answer_score(spark):
    df = spark.createDataFrame([([0.5, 1.0],), ([],)], "s array<double>")
    assert [r[0] for r in df.select(S.answer_score("s")).collect()] == [0.75, None]


def test_losses_stay_finite(spark):
    df = spark.createDataFrame([(-400.0, 400.0), (400.0, -400.0)], "rc double, rr double")
    assert stats.bt_loss(df).first()["loss"] == pytest.approx(400.0)
    bce = spark.createDataFrame([(1, 1000.0), (0, -1000.0), (1, -1000.0)], "label int, logit double")
    assert stats.bce_loss(bce).first()["loss"] == pytest.approx(-math.log(1e-10) / 3, rel=1e-6)


def test_two_head_loss(spark):
    rows = [(0, 10, 5, [1.0, 0.2], [0.5, 0.1]), (0, 7, 9, [0.3, 0.4], [0.9, 0.0]), (1, 3, 3, [1.0, 1.0], [0.0, 0.0])]
    df = spark.createDataFrame(
        rows, "batch int, length_chosen int, length_rejected int, chosen array<double>, rejected array<double>"
    )
    got = {r["batch"]: r for r in stats.two_head_loss(df).collect()}
    length, h0, h1 = [10, 5, 7, 9], [1.0, 0.5, 0.3, 0.9], [0.2, 0.1, 0.4, 0.0]
    gap = (1.0 + 0.2 - 0.6) + (0.3 + 0.4 - 0.9)
    assert got[0]["ranking_loss"] == pytest.approx(math.log1p(math.exp(-gap)))
    assert got[0]["loss_follow"] == pytest.approx(1 - np.corrcoef(length, h0)[0, 1])
    assert got[0]["loss_avoid"] == pytest.approx(abs(np.corrcoef(length, h1)[0, 1]))
    assert got[1]["loss_follow"] is None


def test_section_scores(spark):
    registry = benchmark.benchmark_registry(spark)
    rows = [("alpacaeval-easy", 1.0), ("alpacaeval-easy", 0.5), ("mt-bench-med", 0.0)]
    acc = benchmark.subset_accuracy(spark.createDataFrame(rows, "subset string, correct double"), registry)
    got = {r["subset"]: r["accuracy"] for r in acc.collect()}
    assert len(got) == 23 and got["alpacaeval-easy"] == 0.75 and got["hep-go"] is None
    sections = {r["section"]: r["score"] for r in benchmark.section_scores(acc).collect()}
    assert sections == {"Chat": round(100 * 75 / 140, 2), "Chat Hard": 0.0, "Safety": 0.0, "Reasoning": 0.0}
    assert benchmark.overall_score(benchmark.section_scores(acc)).first()["score"] == round(sections["Chat"] / 4, 2)
    pairwise = {r["subset"]: r["example_count"] for r in benchmark.benchmark_registry(spark, K.PAIRWISE_COUNTS).collect()}
    assert pairwise["xstest-should-refuse"] == 154 and pairwise["xstest-should-respond"] == 250


def test_argmin_takes_the_smaller_parameter(spark):
    rows = [(0, 1.0, 0.5), (0, 0.1, 0.5), (0, 10.0, 0.7), (1, 1.0, None)]
    got = stats.argmin_by_group(spark.createDataFrame(rows, "attr int, alpha double, loss double")).collect()
    assert [tuple(r) for r in got] == [(0, 0.1, 0.5)]


# Ranks


def reference_ranks(values):
    values = np.asarray(values, dtype=float)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


@pytest.mark.parametrize("buckets", [2, 16, 256])
def test_average_ranks(spark, buckets):
    values = np.concatenate([RNG.normal(size=300).round(2), np.full(200, 0.5), [1e9, -1e9]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    ranked = ranks.with_average_rank(df.repartition(5), "v", "id", buckets=buckets).orderBy("id").collect()
    assert [r["rank"] for r in ranked] == reference_ranks(values).tolist()


def test_rank_join_treats_cold_and_hot_values_alike(spark, monkeypatch):
    values = [1.0] * 50 + [float(i) for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    for limit in (1, 10, 10_000):
        monkeypatch.setattr(ranks, "HOT_VALUES", limit)
        got = ranks.with_average_rank(df, "v", "id").orderBy("id").collect()
        assert [r["rank"] for r in got] == reference_ranks(values).tolist()


def spearman(spark, x, y):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    return ranks.spearman(df, "x", "y").first()["corr"]


def test_spearman(spark):
    x = RNG.normal(size=200).round(1).tolist()
    y = (np.array(x) + RNG.normal(size=200)).round(1).tolist()
    want = np.corrcoef(reference_ranks(x), reference_ranks(y))[0, 1]
    assert spearman(spark, x, y) == pytest.approx(want, abs=1e-12)
    assert spearman(spark, [1.0, 2.0, 3.0], [9.0, 5.0, 1.0]) == pytest.approx(-1.0)
    assert spearman(spark, [1.0, 1.0, 1.0], [9.0, 5.0, 1.0]) is None
    assert spearman(spark, [1.0], [2.0]) is None
    assert spearman(spark, [1.0, 2.0, None], [2.0, 3.0, 1.0]) == pytest.approx(1.0)


def reference_penalties(v, dim, threshold):
    k = v.shape[1]
    penalty, corr = np.ones(k), np.ones(k)
    open_dims = set(range(k)) - {dim}
    for p in K.VERBOSITY_GRID:
        for j in sorted(open_dims):
            c = np.corrcoef(reference_ranks(np.round(v[:, j] - p * v[:, dim], 9)), reference_ranks(v[:, dim]))[0, 1]
            if c <= threshold:
                open_dims.remove(j)
                penalty[j], corr[j] = p, c
            else:
                corr[j] = min(corr[j], c)
    return penalty, corr


@pytest.mark.parametrize("threshold", [0.03, 0.3, -2.0])
@pytest.mark.parametrize(("per_pass", "ranges"), [(5, 4), (64, 256)])
def test_verbosity_penalties(spark, threshold, per_pass, ranges):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 4)).round(6)
    v[:, 0] += 0.4 * v[:, 2]
    v[:, 1] -= 0.5 * v[:, 2]
    v[:, 3] += 3 * v[:, 2]
    v = v.round(6)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(150)], "id long, rewards array<double>")
    out = ranks.verbosity_penalties(df, dim=2, threshold=threshold, per_pass=per_pass, ranges=ranges)
    got = out.orderBy("objective").collect()
    penalty, corr = reference_penalties(v, 2, threshold)
    assert [r["penalty"] for r in got] == penalty.tolist()
    np.testing.assert_allclose([r["corr"] for r in got], corr, atol=1e-12)


@pytest.mark.parametrize("decimals", [1, 9])
@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_bounds_of_rank_correlations_hold(spark, decimals, ranges):
    """With few decimals most values are tied and lie on the cuts; a third of the rows is one value."""
    rng = np.random.default_rng(ranges)
    v = rng.normal(size=(3000, 3)).round(decimals)
    v[:1000, 0] = 0.5
    y = reference_ranks(v[:, 2])
    rows = [(r.tolist(), float(r[2]), float(k)) for r, k in zip(v, y - y.mean())]
    df = spark.createDataFrame(rows, "_r array<double>, _v double, _ry double").repartition(3)
    points = [(j, p) for j in (0, 1) for p in K.VERBOSITY_GRID]
    bounds = ranks._bounds(df, points, v[::10], 2, decimals, ranges)
    rounded = [F.round(F.col("_r")[j] - F.lit(p) * F.col("_v"), decimals).alias(f"x{i}") for i, (j, p) in enumerate(points)]
    table = df.select("_ry", *rounded).toPandas()
    for i, (low, high) in enumerate(bounds):
        assert low <= np.corrcoef(reference_ranks(table[f"x{i}"].to_numpy()), table["_ry"])[0, 1] <= high
    if (decimals, ranges) == (9, 256):
        assert max(high - low for (j, _), (low, high) in zip(points, bounds) if j == 1) < 0.05


def test_penalties_of_constant_and_missing_rewards(spark):
    """A constant objective never passes; a row without a reward only sends its objective to the exact ranks."""
    rows = [(i, [float(i % 7), 1.0, float(i), None if i == 3 else float(-i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, rewards array<double>")
    got = {r.objective: (r.penalty, r.corr) for r in ranks.verbosity_penalties(df, dim=2, grid=[0.0]).collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (1.0, 1.0) and got[3][0] == 0.0
    empty = ranks.verbosity_penalties(df.limit(0), objectives=3, dim=2).orderBy("objective").collect()
    assert [(r.penalty, r.corr) for r in empty] == [(1.0, 1.0)] * 3


# Choosing answers


def answers(spark, rows):
    return spark.createDataFrame(rows, "q_id int, ans_idx int, score double, label int")


def test_answer_arrays_explode_in_order(spark):
    df = spark.createDataFrame([(1, "p", ["x", "y", "z"], [0, 1, 0])], "q_id int, prompt string, answers array<string>, label array<int>")
    first = steps.first_n_answers(df, 2)
    assert [tuple(r) for r in steps.explode_answers(first).orderBy("ans_idx").collect()] == [(1, "p", 0, "x", 0), (1, "p", 1, "y", 1)]
    assert steps.first_n_answers(steps.explode_answers(df), 2).count() == 2


def test_best_of_n_ties_and_limit(spark):
    df = answers(spark, [(1, 0, 0.5, 0), (1, 1, 0.5, 1), (1, 2, 0.9, 1), (2, 0, 0.1, 1)])
    got = {r["q_id"]: (r["ans_idx"], r["correct"]) for r in ranking.best_of_n(df, 2).collect()}
    assert got == {1: (0, False), 2: (0, True)}
    assert {r["q_id"]: r["ans_idx"] for r in ranking.best_of_n(df).collect()}[1] == 2


def test_majority_vote_ties(spark):
    rows = [(1, 0, "x", 0), (1, 1, "y", 1), (1, 2, "y", 1), (1, 3, "x", 0), (2, 0, "z", 1)]
    df = spark.createDataFrame(rows, "q_id int, ans_idx int, final_answer string, label int")
    got = {r["q_id"]: (r["final_answer"], r["votes"], r["correct"]) for r in ranking.majority_vote(df).collect()}
    assert got == {1: ("x", 2, False), 2: ("z", 1, True)}


@pytest.mark.parametrize("batch", [False, True])
def test_tournament(spark, batch):
    rows = [(q, i, float((i * 7 + q) % n), 0) for q, n in ((1, 1), (2, 2), (3, 5), (4, 13)) for i in range(n)]
    df = answers(spark, rows)
    seen = []

    def by_batch(matches):
        seen.append(matches)
        return matches.withColumn("prob_a", S.sigmoid(F.col("a.score") - F.col("b.score")))

    rule = by_batch if batch else lambda a, b: S.sigmoid(a["score"] - b["score"])
    got = {r["q_id"]: r["score"] for r in ranking.tournament(df, rule, batch=batch).collect()}
    assert got == {1: 0.0, 2: 1.0, 3: 4.0, 4: 12.0}
    if batch:
        assert len(seen) == 4


def test_tournament_goes_round_by_round(spark):
    """0 beats 1, 3 beats 2, 3 beats 0, whatever 1 against 3 would give."""
    df = spark.createDataFrame([(1, i) for i in range(4)], "q_id int, ans_idx int")
    beats = [(0, 1), (3, 2), (3, 0), (1, 3)]
    wins = lambda a, b: F.when(
        F.concat_ws(">", a["ans_idx"], b["ans_idx"]).isin(*[f"{x}>{y}" for x, y in beats]), 1.0
    ).otherwise(0.0)
    assert ranking.tournament(df, wins).first()["ans_idx"] == 3
