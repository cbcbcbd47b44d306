"""Expressions over logits, rewards and gate weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefops import constants as K


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax_pair(la: str | Column, lb: str | Column, temperature: float = 1.0) -> Column:
    """exp(la/T) / (exp(la/T) + exp(lb/T)), in the form that does not overflow."""
    return sigmoid((_col(la) - _col(lb)) / F.lit(float(temperature)))


def preference_from_prob(p: str | Column) -> Column:
    """0.5 at exactly 0.5, else 1 or 0."""
    c = _col(p)
    return F.when(c == 0.5, F.lit(0.5)).otherwise((c > 0.5).cast("double"))


def preference_from_logits(
    a_first: str | Column, b_first: str | Column, a_second: str | Column, b_second: str | Column
) -> Column:
    """The preference that `debiased_prob` stands for, decided before any rounding.

    σ(x) + σ(y) is above 1 exactly when x + y is above 0, so the margins of
    both orders are added and no exponential can turn a tie into a win.
    """
    margin = (_col(a_first) - _col(b_first)) + (_col(b_second) - _col(a_second))
    return F.when(margin == 0, F.lit(0.5)).otherwise((margin > 0).cast("double"))


def debiased_prob(
    a_first: str | Column, b_first: str | Column, a_second: str | Column, b_second: str | Column, temperature: float = 1.0
) -> Column:
    """Mean probability of the chosen answer over both positions.

    `*_first` are the logits of labels A and B with the chosen answer at A,
    `*_second` those with the chosen answer at B.
    """
    return (softmax_pair(a_first, b_first, temperature) + softmax_pair(b_second, a_second, temperature)) / 2


def consistent_preference(orig: str | Column, swapped: str | Column) -> Column:
    """1 when the second answer wins in both orders, -1 when the first does, else 0."""
    o, s = _col(orig), _col(swapped)
    return (
        F.when((o == "B") & (s == "A"), F.lit(1)).when((o == "A") & (s == "B"), F.lit(-1)).otherwise(F.lit(0))
    )


def pair_outcome(chosen: str | Column, rejected: str | Column, ties: str = "half") -> Column:
    """1 when the chosen reward is larger; a tie counts half (`half`) or nothing (`lose`)."""
    if ties not in ("half", "lose"):
        raise ValueError(ties)
    c, r = _col(chosen), _col(rejected)
    won = F.when(c > r, F.lit(1.0))
    if ties == "half":
        won = won.when(c == r, F.lit(0.5))
    return won.when(c.isNull() | r.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))


def confidence(prob: str | Column) -> Column:
    p = _col(prob)
    return F.greatest(p, F.lit(1.0) - p)


def dot(x: str | Column, y: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(_col(x), _col(y), lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )


def bt_loss_term(chosen: str | Column, rejected: str | Column) -> Column:
    """-log σ(chosen - rejected), finite for any finite difference."""
    d = _col(chosen) - _col(rejected)
    return F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))


def bce_term(label: str | Column, logit: str | Column, eps: float = 1e-10) -> Column:
    y, p = _col(label).cast("double"), sigmoid(_col(logit))
    return -(y * F.log(p + F.lit(eps)) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p + F.lit(eps)))


def matrix(vectors: pa.Array) -> np.ndarray:
    """The non-null rows of an array column as one matrix, without a copy per row.

    Rows of different lengths and null elements are errors.
    """
    rows = vectors.drop_null()
    if not len(rows):
        return np.empty((0, 0))
    widths = np.unique(np.asarray(rows.value_lengths()))
    values = rows.flatten()
    if len(widths) > 1 or values.null_count:
        raise ValueError(f"vectors of {widths.tolist()} elements, {values.null_count} of them null, where one length is needed")
    return np.asarray(values, dtype=np.float64).reshape(len(rows), -1)


def _like(rows: np.ndarray, source: pa.Array) -> pa.Array:
    """`rows` as an array column, null where `source` is null."""
    present = np.asarray(source.is_valid())
    width = rows.shape[1] if len(rows) else 0
    offsets = np.concatenate([[0], np.cumsum(present * width)]).astype(np.int32)
    mask = pa.array(~present) if not present.all() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)), mask=mask)


def objective_rewards(embedding: str | Column, weights: np.ndarray) -> Column:
    """One reward per objective: embedding · Wᵀ, a matrix product per Arrow batch.

    `weights` (objectives × d) travels with the task; it does not grow with the data.
    """
    transposed = np.ascontiguousarray(np.asarray(weights, dtype=np.float64).T)

    @F.arrow_udf("array<double>")
    def product(batch: pa.Array) -> pa.Array:
        x = matrix(batch)
        return _like(x @ transposed if len(x) else np.empty((0, 0)), batch)

    return product(_col(embedding))


def gate_logits(
    prompt_embedding: str | Column, layers: Sequence[tuple[np.ndarray, np.ndarray | None]]
) -> Column:
    """Output of the gate's layers: Linear+ReLU for all but the last.

    `layers` holds (weight out×in, bias or None).
    """
    return _gate(prompt_embedding, layers, lambda x: x)


def gate_weights(
    prompt_embedding: str | Column,
    layers: Sequence[tuple[np.ndarray, np.ndarray | None]],
    temperature: float = 10.0,
    logit_scale: float = 1.0,
) -> Column:
    """Softmax gate over the objectives: softmax(logits / T) × scale."""
    return _gate(prompt_embedding, layers, lambda x: softmax_rows(x, temperature) * logit_scale)


def _gate(embedding: str | Column, layers: Sequence, finish: Callable[[np.ndarray], np.ndarray]) -> Column:
    frozen = [
        (np.asarray(w, dtype=np.float64).T.copy(), None if b is None else np.asarray(b, dtype=np.float64))
        for w, b in layers
    ]

    @F.arrow_udf("array<double>")
    def gate(batch: pa.Array) -> pa.Array:
        x = matrix(batch)
        if not len(x):
            return _like(x, batch)
        for i, (w, b) in enumerate(frozen):
            x = x @ w if b is None else x @ w + b
            if i < len(frozen) - 1:
                x = np.maximum(x, 0.0)
        return _like(finish(x), batch)

    return gate(_col(embedding))


def side_weights(logits: str | Column, other: str | Column, temperature: float = 10.0) -> Column:
    """Gate normalised between the two sides of a pair, objective by objective."""
    t = F.lit(float(temperature))
    return F.zip_with(_col(logits), _col(other), lambda a, b: sigmoid((a - b) / t))


def softmax_rows(x: np.ndarray, temperature: float) -> np.ndarray:
    z = x / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def verbosity_transform(rewards: str | Column, penalties: Sequence[float], dim: int = K.VERBOSITY_DIM) -> Column:
    """Take penalty_j · r_dim from every reward r_j."""
    r, pen = _col(rewards), _doubles(penalties)
    return F.transform(r, lambda x, j: x - F.get(pen, j) * F.get(r, F.lit(dim)))


def mixture_coefficients(
    gate: str | Column, penalties: Sequence[float] | None = None, dim: int = K.VERBOSITY_DIM
) -> Column:
    """Coefficients of the raw rewards; with `penalties` the debiasing is folded into them.

    Scoring debiased rewards with the gate equals scoring raw rewards with a
    gate whose weight at `dim` is lowered by Σ penalty_j · gate_j.
    """
    g = _col(gate)
    if penalties is None:
        return g
    moved = dot(g, _doubles(penalties))
    return F.transform(g, lambda x, j: F.when(j == dim, x - moved).otherwise(x))


def mixture_score(
    rewards: str | Column, gate: str | Column, penalties: Sequence[float] | None = None, dim: int = K.VERBOSITY_DIM
) -> Column:
    """Σ rewards · coefficients. Raw rewards unless `penalties` are given."""
    return dot(rewards, mixture_coefficients(gate, penalties, dim))


def top_objectives(coeffs: str | Column, k: int = 3, names: Sequence[str] = K.OBJECTIVES) -> Column:
    """The k objectives with the largest |coefficient|: array of (idx, name, coeff)."""
    labels = F.array(*[F.lit(n) for n in names])
    keyed = F.transform(
        _col(coeffs), lambda c, i: F.struct((-F.abs(c)).alias("size"), i.alias("idx"), c.alias("coeff"))
    )
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(
        best,
        lambda s: F.struct(
            s["idx"].alias("idx"), F.get(labels, s["idx"]).alias("name"), s["coeff"].alias("coeff")
        ),
    )


def denormalize(rewards: str | Column, n: int = 5) -> Column:
    """First n rewards on their original scale: r · 5 - 0.5."""
    return F.transform(F.slice(_col(rewards), 1, n), lambda r: r * 5 - 0.5)


def answer_score(step_scores: str | Column) -> Column:
    """Mean of the step scores of one answer; null for none."""
    s = _col(step_scores)
    total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.try_divide(total, F.size(s).cast("double"))
