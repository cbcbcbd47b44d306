"""Small models on frozen embeddings, fitted from distributed sums.

Whatever leaves the tasks has the size of the model (d × d, or objectives × d)
and not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.operators import benchmark
from prefops.operators.gate import GATE_FORMS, SIGNS, Gate, fit_gate, gate_loss
from prefops.operators.ordering import train_val_split
from prefops.operators.sums import GROUPS
from prefops.schema import require
from prefops.sources.io import written

OPEN_PATTERNS = 8


def label_columns(df: DataFrame, attrs: Sequence[str], labels: str = "labels") -> DataFrame:
    """An array of labels as one nullable column per attribute; NaN stands for a label that is absent.

    An array of another length than `attrs` is an error, a null one has no labels.
    """
    require(df, labels)
    array = F.when(
        F.size(labels) != len(attrs), F.raise_error(F.lit(f"not {len(attrs)} labels")).cast("array<double>")
    ).otherwise(F.col(labels).cast("array<double>"))
    columns = {a: F.nullif(F.get(array, F.lit(i)), F.lit(float("nan"))) for i, a in enumerate(attrs)}
    return df.withColumns(columns).drop(labels)


def _known(attr: str) -> Column:
    """A label, null where it is NaN."""
    return F.nullif(F.col(attr).cast("double"), F.lit(float("nan")))


def triangle(blocks: Sequence[np.ndarray]) -> np.ndarray:
    """The R factor of some blocks of rows on top of each other: as many columns, no more rows, the same products."""
    return np.linalg.qr(np.vstack(blocks), mode="r")


FACTOR = "pattern string, split boolean, n long, r array<double>"


def factor_partials(df: DataFrame, features: str, attrs: Sequence[str], split: str) -> DataFrame:
    """R factors of (X, Y) per task, split and pattern of known labels: (pattern, split, n, r).

    A pattern has a character per attribute, 1 where its label is known, and r
    the columns of X and of the known labels. Attributes labelled by the same
    source share a pattern and therefore a factor. n is the number of rows.
    """
    pattern = F.concat(*[F.when(_known(a).isNotNull(), F.lit("1")).otherwise(F.lit("0")) for a in attrs])
    labels = F.array(*[F.coalesce(_known(a), F.lit(0.0)) for a in attrs])
    rows = df.where(F.col(features).isNotNull()).select(
        F.coalesce(F.col(split).cast("boolean"), F.lit(False)).alias("split"), pattern.alias("pattern"), F.col(features).alias("x"), labels.alias("y")
    )

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[str, bool], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = S.matrix(batch.column("x")), S.matrix(batch.column("y"))
            groups = pa.table({"p": batch.column("pattern"), "s": batch.column("split"), "at": np.arange(len(x))})
            groups = groups.group_by(["p", "s"]).aggregate([("at", "list")])
            for p, s, at in zip(groups["p"].to_pylist(), groups["s"].to_pylist(), groups["at_list"], strict=True):
                at, known = at.values.to_numpy(), np.array([c == "1" for c in p])
                block = np.hstack([x[at], y[at][:, known]])
                have = open_.setdefault((p, s), [0, []])
                have[0] += len(at)
                have[1].append(block)
                # Rows wait until there are twice as many as columns.
                if sum(map(len, have[1])) > 2 * block.shape[1]:
                    have[1] = [triangle(have[1])]
                if len(open_) > OPEN_PATTERNS:
                    yield from _factors(open_)
        yield from _factors(open_)

    return rows.mapInArrow(partials, FACTOR)


def _factors(open_: dict[tuple[str, bool], list]) -> Iterator[pa.RecordBatch]:
    """Emit and forget the open factors, one batch per pattern."""
    for (pattern, split), (n, blocks) in open_.items():
        yield _factor_row(pattern, split, n, triangle(blocks))
    open_.clear()


def _factor_row(pattern: str, split: bool, n: int, r: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array([0, r.size], pa.int32()), pa.array(r.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array([pattern]), pa.array([split]), pa.array([n], pa.int64()), flat], ["pattern", "split", "n", "r"])


def _stacked(table: pa.Table, width: int) -> tuple[int, np.ndarray]:
    """Rows in all, and the factor of all factors of a table, two at a time."""
    total = np.zeros((0, width))
    for r in table["r"]:
        total = triangle([total, r.values.to_numpy().reshape(-1, width)])
    return sum(table["n"].to_pylist()), total


def ridge_path(
    df: DataFrame,
    attrs: Sequence[str],
    features: str = "embedding",
    alphas: Sequence[float] = K.RIDGE_ALPHAS,
    split: str = "is_val",
) -> DataFrame:
    """Ridge without intercept for every attribute and alpha: (attr_idx, attribute, alpha, loss, weight).

    Fitted on the rows outside `split`, loss is the mean squared error inside
    it. An attribute without a label on either side has no row. NaN is no label.

    Tasks reduce their rows to orthogonal factors, which are joined in a tree, so
    X is never multiplied with itself and its condition isn't squared. An
    attribute's factor, in a task of its own, gives the weights of all alphas by
    one singular value decomposition; the loss comes from the factor of the other side.
    """
    require(df, features, split, *attrs)
    parts = factor_partials(df, features, attrs, split)
    m, names, grid = len(attrs), list(attrs), [float(a) for a in alphas]

    def joined(table: pa.Table) -> pa.Table:
        pattern = table["pattern"][0].as_py()
        width = table["width"][0].as_py() + pattern.count("1")
        n, r = _stacked(table, width)
        return pa.Table.from_batches([_factor_row(pattern, table["split"][0].as_py(), n, r)]).append_column("width", pa.array([width - pattern.count("1")], pa.int32()))

    width = df.where(F.col(features).isNotNull()).select(F.size(features).alias("w")).limit(1).scalar()
    sized = parts.withColumn("width", F.coalesce(width, F.lit(0)).cast("int"))
    some = sized.withColumn("group", F.spark_partition_id() % GROUPS)
    schema = FACTOR + ", width int"
    grouped = some.groupBy("pattern", "split", "group").applyInArrow(joined, schema)
    by_pattern = grouped.groupBy("pattern", "split").applyInArrow(joined, schema)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """X and the column of one attribute, for every attribute of a pattern."""
        for batch in batches:
            for pattern, s, n, r, d in zip(*(batch.column(c) for c in ("pattern", "split", "n", "r", "width")), strict=True):
                known = [a for a in range(m) if pattern.as_py()[a] == "1"]
                matrix = r.values.to_numpy().reshape(-1, d.as_py() + len(known))
                for k, a in enumerate(known):
                    one = np.hstack([matrix[:, : d.as_py()], matrix[:, d.as_py() + k :][:, :1]])
                    row = _factor_row("", s.as_py(), n.as_py(), one)
                    yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), *row.columns[1:], pa.array([d.as_py()], pa.int32())], ["attr_idx", "split", "n", "r", "width"])

    systems = by_pattern.mapInArrow(own, "attr_idx int, split boolean, n long, r array<double>, width int")
    out_schema = "attr_idx int, attribute string, alpha double, loss double, weight array<double>"

    def solve(table: pa.Table) -> pa.Table:
        a, d = table["attr_idx"][0].as_py(), table["width"][0].as_py()
        is_val = table["split"].combine_chunks()
        sides = [table.filter(pc.equal(is_val, v)) for v in (False, True)]
        rows: list[tuple] = []
        if all(len(side) for side in sides):
            (_, fit), (n_val, val) = (_stacked(side, d + 1) for side in sides)
            u, s, vt = np.linalg.svd(fit[:, :d], full_matrices=False)
            along = u.T @ fit[:, d]
            for alpha in grid:
                scale = np.divide(s, s * s + alpha, out=np.zeros_like(s), where=s * s + alpha > 0)
                w = vt.T @ (scale * along)
                loss = float(((val[:, :d] @ w - val[:, d]) ** 2).sum()) / n_val
                rows.append((a, names[a], alpha, loss, w.tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["attr_idx", "attribute", "alpha", "loss", "weight"])

    return systems.groupBy("attr_idx").applyInArrow(solve, out_schema)


def fit_ridge_probe(
    df: DataFrame,
    attrs: Sequence[str],
    key: str = "id",
    features: str = "embedding",
    alphas: Sequence[float] = K.RIDGE_ALPHAS,
    frac: float = 0.2,
    seed: int | str = 42,
) -> DataFrame:
    """Best ridge probe per attribute, chosen on the validation split and fitted on the rest.

    One row per attribute that has labels: (attr_idx, attribute, alpha, loss, weight).
    """
    path = ridge_path(train_val_split(df, key, frac, seed), attrs, features, alphas)
    best = F.min_by(F.struct("attribute", "alpha", "loss", "weight"), F.struct("loss", "alpha")).alias("_b")
    return path.groupBy("attr_idx").agg(best).select("attr_idx", "_b.*")


def weight_matrix(probes: DataFrame, n: int | None = None) -> np.ndarray:
    """Weights of the attributes, one row each at its index, as a matrix on the driver (objectives × d).

    An attribute among the n (by default up to the last that has weights) for
    which no probe could be fitted is an error: the others would move up.
    """
    rows = {r["attr_idx"]: r["weight"] for r in probes.select("attr_idx", "weight").collect()}
    n = max(rows, default=-1) + 1 if n is None else n
    if missing := [i for i in range(n) if i not in rows]:
        raise ValueError(f"no probe for the attributes {missing}")
    return np.array([rows[i] for i in range(n)])


def _head(rows: DataFrame, reg: float, max_iter: int) -> LogisticRegressionModel:
    fit = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=reg, fitIntercept=False, standardization=False, maxIter=max_iter, tol=1e-9
    )
    return fit.fit(rows)


def fit_bt_head(
    df: DataFrame, chosen: str = "chosen_emb", rejected: str = "rejected_emb", reg: float = 1e-3, max_iter: int = 100
) -> LogisticRegressionModel:
    """Linear reward on embeddings under the pairwise logistic loss.

    Each pair enters as its difference with label 1 and as the opposite with
    label 0; both terms have the same loss, so the optimum is that of the pairs.
    """
    require(df, chosen, rejected)
    gap = F.zip_with(chosen, rejected, lambda c, r: c.cast("double") - r.cast("double"))
    both = F.array(
        F.struct(F.lit(1.0).alias("_y"), gap.alias("_g")),
        F.struct(F.lit(0.0).alias("_y"), F.transform(gap, lambda v: -v).alias("_g")),
    )
    rows = df.select(F.inline(both)).select("_y", array_to_vector("_g").alias("_x"))
    return _head(rows, reg, max_iter)


def fit_orm_head(
    df: DataFrame, features: str = "embedding", label: str = "label", reg: float = 1e-3, max_iter: int = 100
) -> LogisticRegressionModel:
    """Linear +/- classifier of answers on embeddings."""
    require(df, features, label)
    rows = df.select(
        F.col(label).cast("double").alias("_y"),
        array_to_vector(F.transform(F.col(features), lambda v: v.cast("double"))).alias("_x"),
    )
    return _head(rows, reg, max_iter)


def head_reward(embedding: str | Column, model: LogisticRegressionModel) -> Column:
    """Reward of a fitted linear head as a column."""
    weights = model.coefficients.toArray()[None, :]
    return F.get(S.objective_rewards(embedding, weights), F.lit(0))


def _objective_gaps(df: DataFrame, first: str, second: str, n: int) -> DataFrame:
    gaps = {f"_g{i}": (F.get(first, F.lit(i)) - F.get(second, F.lit(i))).cast("double") for i in range(n)}
    return VectorAssembler(inputCols=list(gaps), outputCol="_x").transform(df.withColumns(gaps)).drop(*gaps)


def fit_preference_tree(
    df: DataFrame, first: str = "rewards_1", second: str = "rewards_2", label: str = "preference", depth: int = 5, n: int = 5
) -> DecisionTreeClassificationModel:
    """Decision tree from the differences of n objectives to the preferred index (0 or 1)."""
    require(df, first, second, label)
    rows = _objective_gaps(df, first, second, n).withColumn("_y", F.col(label).cast("double"))
    return DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, seed=0).fit(rows)


def preference_from_objectives(
    df: DataFrame,
    model: DecisionTreeClassificationModel,
    first: str = "rewards_1",
    second: str = "rewards_2",
    name: str = "preference",
    n: int = 5,
) -> DataFrame:
    """Index of the preferred answer by a fitted tree."""
    require(df, first, second)
    scored = model.transform(_objective_gaps(df, first, second, n))
    kept = [c for c in df.columns if c != name]
    return scored.select(*kept, F.col("prediction").cast("int").alias(name))


def mixture_pairs(
    df: DataFrame,
    weights: np.ndarray,
    layers: Sequence[tuple[np.ndarray, np.ndarray | None]],
    temperature: float = 10.0,
    penalties: Sequence[float] | None = None,
    dim: int = K.VERBOSITY_DIM,
    over: str = "objectives",
) -> DataFrame:
    """Score both sides of embedded pairs with the gated mixture: adds score_chosen, score_rejected, correct.

    The gate's softmax runs over the objectives of one answer. `over="sides"`
    runs it between the two answers of a pair, objective by objective, which is
    what a softmax over the second axis does to a (pairs, 2, objectives) array.
    """
    require(df, "chosen_emb", "rejected_emb", "chosen_prompt_emb", "rejected_prompt_emb")
    if over not in GATE_FORMS:
        raise ValueError(over)
    out = df
    for side in SIGNS:
        prompt = f"{side}_prompt_emb"
        gate = S.gate_weights(prompt, layers, temperature) if over == "objectives" else S.gate_logits(prompt, layers)
        out = out.withColumn(f"_r_{side}", S.objective_rewards(f"{side}_emb", weights)).withColumn(f"_g_{side}", gate)
    if over == "sides":
        out = out.withColumn("_g_chosen", S.side_weights("_g_chosen", "_g_rejected", temperature)).withColumn(
            "_g_rejected", F.transform("_g_chosen", lambda g: 1.0 - g)
        )
    for side in SIGNS:
        out = out.withColumn(f"score_{side}", S.mixture_score(f"_r_{side}", f"_g_{side}", penalties, dim))
    return out.withColumn("correct", S.pair_outcome("score_chosen", "score_rejected", ties="lose")).select(
        *df.columns, "score_chosen", "score_rejected", "correct"
    )


def eval_gate(scored: DataFrame, registry: DataFrame) -> DataFrame:
    """Unrounded section scores of scored benchmark pairs (`subset`, `correct`)."""
    return benchmark.section_scores(benchmark.subset_accuracy(scored, registry), decimals=None)
