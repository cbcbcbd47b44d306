import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.operators import fit
from prefops.operators import gate as gate_module
from prefops.operators.ordering import train_val_split
from prefops.plans import reward_mixture

ATTRS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def labelled(spark):
    """a, b on half the rows each way, c nowhere, d on validation rows only, e on training rows only."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    w = rng.normal(size=(2, 6))
    y = x @ w.T + rng.normal(size=(400, 2))
    val = {r["id"] for r in train_val_split(spark.range(400), "id").where("is_val").collect()}
    rows = []
    for i in range(400):
        rows.append(
            (
                i,
                x[i].tolist(),
                float(y[i, 0]) if i % 2 == 0 else None,
                float(y[i, 1]) if i % 3 else None,
                None,
                1.0 if i in val else None,
                None if i in val else 1.0,
            )
        )
    df = spark.createDataFrame(rows, "id long, embedding array<double>, a double, b double, c double, d double, e double")
    return df.repartition(5), rows, val


def dense(rows, val, column):
    known = [r for r in rows if r[column] is not None]
    side = lambda inside: (
        np.array([r[1] for r in known if (r[0] in val) == inside]),
        np.array([r[column] for r in known if (r[0] in val) == inside]),
    )
    (xt, yt), (xv, yv) = side(False), side(True)
    best = None
    for alpha in K.RIDGE_ALPHAS:
        w = np.linalg.solve(xt.T @ xt + alpha * np.eye(xt.shape[1]), xt.T @ yt)
        loss = ((yv - xv @ w) ** 2).mean()
        if best is None or loss < best[1]:
            best = (alpha, loss, w)
    return best


def test_ridge_equals_a_dense_solve(labelled):
    df, rows, val = labelled
    got = {r["attribute"]: r for r in fit.fit_ridge_probe(df, ATTRS).collect()}
    assert set(got) == {"a", "b"}
    for column, name in ((2, "a"), (3, "b")):
        alpha, loss, w = dense(rows, val, column)
        assert got[name]["alpha"] == alpha
        assert got[name]["loss"] == pytest.approx(loss, rel=1e-9)
        np.testing.assert_allclose(got[name]["weight"], w, rtol=1e-9)


def test_ridge_with_many_label_patterns(labelled, monkeypatch):
    """Open sums are emitted early when there are too many of them."""
    df, _, _ = labelled
    want = {r["attribute"]: r["weight"] for r in fit.fit_ridge_probe(df, ["a", "b"]).collect()}
    monkeypatch.setattr(fit, "OPEN_PATTERNS", 1)
    got = {r["attribute"]: r["weight"] for r in fit.fit_ridge_probe(df, ["a", "b"]).collect()}
    for name in want:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-9)


def test_weight_matrix_is_in_attribute_order(labelled):
    probes = fit.fit_ridge_probe(labelled[0], ["b", "a"])
    matrix = fit.weight_matrix(probes)
    rows = {r["attribute"]: r["weight"] for r in probes.collect()}
    np.testing.assert_array_equal(matrix, [rows["b"], rows["a"]])


@pytest.fixture(scope="module")
def embedded(spark):
    rng = np.random.default_rng(3)
    d, n = 4, 200
    c, r, p = rng.normal(size=(n, d)), rng.normal(size=(n, d)), rng.normal(size=(n, d))
    c[:, 0] += 1.0
    rows = [(i, c[i].tolist(), r[i].tolist(), p[i].tolist(), p[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(
        rows,
        "pair_id long, chosen_emb array<double>, rejected_emb array<double>, "
        "chosen_prompt_emb array<double>, rejected_prompt_emb array<double>",
    )
    return df, c, r, p


def test_pairwise_head_is_at_its_optimum(embedded):
    df, c, r, _ = embedded
    reg = 0.01
    w = fit.fit_bt_head(df, reg=reg).coefficients.toArray()
    gap = c - r
    slope = -(gap / (1 + np.exp(gap @ w))[:, None]).mean(axis=0) + reg * w
    assert np.abs(slope).max() < 1e-4
    assert w[0] > 0.3


def test_head_reward(embedded):
    df, c, _, _ = embedded
    model = fit.fit_bt_head(df)
    got = [r["v"] for r in df.select("pair_id", fit.head_reward("chosen_emb", model).alias("v")).orderBy("pair_id").collect()]
    np.testing.assert_allclose(got, c @ model.coefficients.toArray())


def test_outcome_head_separates(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(i, x[i].tolist(), int(x[i, 1] > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    model = fit.fit_orm_head(df)
    right = df.select((F.col("label") == (fit.head_reward("embedding", model) > 0).cast("int")).alias("ok")).where("ok")
    assert right.count() > 280


def test_ridge_of_badly_conditioned_features(spark):
    """Condition 1e7: sums of squares would leave nothing of the smallest direction."""
    rng = np.random.default_rng(11)
    u, _ = np.linalg.qr(rng.normal(size=(300, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    x = u * np.logspace(0, -7, 6) @ v.T
    y = x @ (v @ np.ones(6)) + 1e-9 * rng.normal(size=300)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 5 == 0) for i in range(300)], "id long, embedding array<double>, y double, is_val boolean").repartition(7)
    fit_on = np.arange(300) % 5 != 0
    for r in fit.ridge_path(df, ["y"], alphas=[0.0, 1e-13, 1e-6]).collect():
        a = np.vstack([x[fit_on], np.sqrt(r.alpha) * np.eye(6)])
        want = np.linalg.lstsq(a, np.append(y[fit_on], np.zeros(6)), rcond=None)[0]
        np.testing.assert_allclose(v.T @ np.array(r.weight), v.T @ want, rtol=1e-6, atol=1e-8)


def test_ridge_of_a_hundred_attributes(spark):
    rng = np.random.default_rng(12)
    x, w = rng.normal(size=(400, 5)), rng.normal(size=(100, 5))
    y = x @ w.T + 0.1 * rng.normal(size=(400, 100))
    known = [[(i + a // 10) % 3 > 0 for a in range(100)] for i in range(400)]
    labels = [[float(y[i, a]) if known[i][a] else float("nan") for a in range(100)] for i in range(400)]
    df = spark.createDataFrame([(i, x[i].tolist(), labels[i], i % 4 == 0) for i in range(400)], "id long, embedding array<double>, labels array<double>, is_val boolean")
    names = [f"t{a}" for a in range(100)]
    rows = fit.ridge_path(fit.label_columns(df, names), names, alphas=[0.5]).collect()
    assert len(rows) == 100
    for r in rows:
        on = np.array([known[i][r.attr_idx] and i % 4 != 0 for i in range(400)])
        off = np.array([known[i][r.attr_idx] and i % 4 == 0 for i in range(400)])
        want = np.linalg.solve(x[on].T @ x[on] + 0.5 * np.eye(5), x[on].T @ y[on, r.attr_idx])
        np.testing.assert_allclose(r.weight, want, rtol=1e-8)
        assert r.loss == pytest.approx(((x[off] @ want - y[off, r.attr_idx]) ** 2).mean(), rel=1e-8)


def dense_step(layers, t, c, r, p, masks=None):
    """Loss and gradients of the network over some pairs whose two sides share the prompt, written out plainly."""
    total, grads = 0.0, [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    for row in range(len(c)):
        acts, gap, back = {}, 0.0, {}
        for side, sign, rewards in (("chosen", 1, c[row]), ("rejected", -1, r[row])):
            a = [p[row]]
            for i, (w, b) in enumerate(layers):
                z = w @ a[-1] + b
                if i < len(layers) - 1:
                    z = np.maximum(z, 0) * (1 if masks is None else masks[side][i][row])
                a.append(z)
            g = np.exp(a[-1] / t - max(a[-1] / t))
            g /= g.sum()
            gap += sign * g @ rewards
            back[side] = sign * (np.diag(g) - np.outer(g, g)) @ rewards / t
            acts[side] = a
        total += np.log1p(np.exp(-gap))
        for side, a in acts.items():
            d = back[side] * (-1 / (1 + np.exp(gap)))
            for i in range(len(layers) - 1, -1, -1):
                grads[i][0][:] += np.outer(d, a[i])
                grads[i][1][:] += d
                d = layers[i][0].T @ d * (a[i] > 0) * (1 if masks is None or not i else masks[side][i - 1][row])
    return total / len(c), [(w / len(c), b / len(c)) for w, b in grads]


def dense_fit(layers, t, c, r, p, steps, lr, chosen=lambda step: slice(None), masks=lambda step, rows: None):
    m = [[np.zeros_like(x) for x in layer] for layer in layers]
    v = [[np.zeros_like(x) for x in layer] for layer in layers]
    losses = []
    for step in range(steps):
        rows = chosen(step)
        loss, grads = dense_step(layers, t, c[rows], r[rows], p[rows], masks(step, rows))
        losses.append(loss)
        rate = lr * (1 + np.cos(np.pi * step / steps)) / 2
        new = []
        for k, layer in enumerate(layers):
            moved = []
            for j, x in enumerate(layer):
                m[k][j] = 0.9 * m[k][j] + 0.1 * grads[k][j]
                v[k][j] = 0.999 * v[k][j] + 0.001 * grads[k][j] ** 2
                moved.append(x - rate * (m[k][j] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k][j] / (1 - 0.999 ** (step + 1))) + 1e-8))
            new.append(tuple(moved))
        layers = new
    return layers, losses


def same_layers(a, b):
    for (w, x), (v, y) in zip(a, b, strict=True):
        np.testing.assert_allclose(w, v, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(x, y, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("hidden", [(), (5,), (6, 5, 4)])
def test_gate_follows_the_dense_gradient(embedded, hidden):
    df, c, r, p = embedded
    w = np.random.default_rng(5).normal(size=(3, 4))
    rows = reward_mixture.gate_rows(df, w)
    start = fit.fit_gate(rows, 3, 4, steps=0, temperature=1.0, hidden=hidden)
    gate = fit.fit_gate(rows, 3, 4, steps=6, lr=0.05, temperature=1.0, hidden=hidden)
    layers, losses = dense_fit(start.layers, 1.0, c @ w.T, r @ w.T, p, 6, 0.05)
    np.testing.assert_allclose(gate.losses, losses, rtol=1e-9)
    same_layers(gate.layers, layers)
    assert [x.shape for x, _ in gate.layers] == [(b, a) for a, b in zip((4, *hidden), (*hidden, 3), strict=True)]
    assert gate.losses[-1] < gate.losses[0]
    assert fit.gate_loss(rows, gate) < losses[0]


def hashes_of(pairs, seed):
    return np.array([int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:8], 16) for k in pairs], np.uint64)


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gate_steps_on_drawn_batches(embedded, dropout):
    """Batches are ranges of the hash of the key; dropout is fixed by the same hash."""
    df, c, r, p = embedded
    w, hidden, seed = np.random.default_rng(5).normal(size=(3, 4)), (6, 5), 4
    h = hashes_of([x.pair_id for x in df.select("pair_id").collect()], seed)
    rng = np.random.default_rng(seed)
    start = gate_module.start_layers(3, 4, hidden, rng)
    places = [rng.random() for _ in range(7)]

    def chosen(step):
        lo = int(places[step] * 2**32)
        width = -(-(2**32) * 30 // len(h))
        return np.flatnonzero((h.astype(np.int64) - lo) % 2**32 < width)

    def masks(step, rows):
        if not dropout:
            return None
        return {s: [gate_module.kept_units(h[rows], (step * 3 + i) * 2 + k, n, dropout) for i, n in enumerate(hidden)] for k, s in enumerate(fit.SIGNS)}

    assert all(5 < len(chosen(s)) < 90 for s in range(7))
    gate = fit.fit_gate(reward_mixture.gate_rows(df, w, "pair_id"), 3, 4, steps=7, lr=0.05, temperature=1.0, seed=seed, hidden=hidden, batch=30, key="pair_id", dropout=dropout)
    layers, losses = dense_fit(start, 1.0, c @ w.T, r @ w.T, p, 7, 0.05, chosen, masks)
    np.testing.assert_allclose(gate.losses, losses, rtol=1e-9)
    same_layers(gate.layers, layers)


def test_a_step_reads_its_batch(spark):
    """A batch comes from the folders of its range, and ranges all around the hashes give every row."""
    rows = spark.range(4000).select(F.expr("id * 4294967296 div 4000").alias("h"), F.array(F.lit(1.0)).alias("x"))
    shelves = gate_module.Shelves(rows, 4000, 100)
    assert shelves.bits == 5 and len(shelves.filled) == 32
    seen = []
    for k in range(40):
        drawn = shelves.draw((k + 0.5) / 40)
        assert len({f.rsplit("/", 2)[1] for f in drawn.inputFiles()}) <= 2
        seen += [x.h for x in drawn.collect()]
    # A row on the border of two ranges is in both, as they are rounded up.
    assert set(seen) == {x.h for x in rows.collect()} and len(seen) <= 4040
    plan = shelves.draw(0.99)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "h" in plan.split("PushedFilters: [")[1][:200]


def test_gate_without_rows_or_keys(spark, embedded):
    rows = reward_mixture.gate_rows(embedded[0], np.ones((3, 4)), "pair_id")
    with pytest.raises(ValueError, match="no rows"):
        fit.fit_gate(rows.where("false"), 3, 4)
    with pytest.raises(ValueError, match="by key"):
        fit.fit_gate(rows, 3, 4, batch=10)
    few = fit.fit_gate(rows.union(rows.limit(1).withColumn("chosen_prompt", F.lit(None).cast("array<double>"))), 3, 4, steps=2, batch=10**6, key="pair_id")
    assert len(few.losses) == 2


def test_dropout_keeps_the_mean():
    kept = gate_module.kept_units(np.arange(4000, dtype=np.uint64), 3, 50, 0.2)
    assert kept.mean() == pytest.approx(1, abs=0.01) and set(np.unique(kept)) == {0.0, 1 / 0.8}
    assert abs(kept.mean(axis=0) - 1).max() < 0.05 and (kept != gate_module.kept_units(np.arange(4000, dtype=np.uint64), 4, 50, 0.2)).any()


@pytest.mark.parametrize("over", ["objectives", "sides"])
def test_gate_slopes_are_derivatives(over):
    rng = np.random.default_rng(7)
    z = {s: rng.normal(size=(3, 4)) for s in fit.SIGNS}
    r = {s: rng.normal(size=(3, 4)) for s in fit.SIGNS}
    gap, slopes = fit.GATE_FORMS[over](z, r, 0.7)
    for side in fit.SIGNS:
        for i in range(3):
            for j in range(4):
                moved = {s: v.copy() for s, v in z.items()}
                moved[side][i, j] += 1e-6
                slope = (fit.GATE_FORMS[over](moved, r, 0.7)[0][i] - gap[i]) / 1e-6
                assert slope == pytest.approx(slopes[side][i, j], abs=1e-5)


def test_gate_over_sides_learns_from_different_prompts(embedded):
    df, *_ = embedded
    pairs = df.withColumn("rejected_prompt_emb", F.reverse("rejected_emb"))
    w = np.random.default_rng(5).normal(size=(3, 4))
    gate = fit.fit_gate(reward_mixture.gate_rows(pairs, w), 3, 4, steps=8, lr=0.05, temperature=1.0, over="sides")
    assert gate.losses[-1] < gate.losses[0]
    same = fit.mixture_pairs(df, w, [(gate.weight, gate.bias)], 1.0, over="sides")
    even = same.select(F.abs(F.col("score_chosen") - S.dot(S.objective_rewards("chosen_emb", w), F.array(*[F.lit(0.5)] * 3))))
    assert max(r[0] for r in even.collect()) < 1e-9


def test_tree_learns_a_threshold(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(300, 5)), rng.normal(size=(300, 5))
    rows = [(i, a[i].tolist(), b[i].tolist(), int(b[i, 1] > a[i, 1])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, rewards_1 array<double>, rewards_2 array<double>, preference int")
    model = fit.fit_preference_tree(df, depth=2)
    found = fit.preference_from_objectives(df.withColumnRenamed("preference", "rule"), model)
    assert found.where("rule = preference").count() >= 295
    example = [
        (0, [3.9603815, 3.9727726, 3.8582935, 0.9909791, 1.4901903], [2.1698856, 2.2035594, 3.2032843, 0.8786768, 1.4569137])
    ]
    one = spark.createDataFrame(example, "id int, rewards_1 array<double>, rewards_2 array<double>")
    assert fit.preference_from_objectives(one, model).first()["preference"] == 0


def test_mixture_end_to_end(labelled, embedded, spark):
    df, *_ = labelled
    pairs = embedded[0].select(
        "pair_id", *[F.concat(c, F.array(F.lit(0.1), F.lit(0.2))).alias(c) for c in embedded[0].columns[1:]]
    )
    made = reward_mixture.fit_mixture(df, ["a", "b"], pairs, dim=1, steps=3)
    assert made.weights.shape == (2, 6) and len(made.penalties) == 2 and len(made.gate.losses) == 3
    assert reward_mixture.validation_accuracy(pairs, made).first()["n"] == 40
    debiased = reward_mixture.scored_pairs(pairs, made, debias=True, dim=1).first()
    assert debiased["score_chosen"] is not None
