"""Multi-objective rewards and their gated mixture, from embeddings to a benchmark report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.operators import fit, ranks
from prefops.operators.ordering import train_val_split
from prefops.sources.io import written


@dataclass
class Mixture:
    """Probe weights, verbosity penalties and gate: all of the size of the model."""

    weights: np.ndarray
    penalties: list[float]
    gate: fit.Gate


def pooled_rewards(pairs: DataFrame, weights: np.ndarray, key: str = "pair_id") -> DataFrame:
    """Rewards of both sides of every pair, one row per side: (id, rewards)."""
    sides = F.array(
        *[
            F.struct(F.concat_ws(":", F.col(key).cast("string"), F.lit(s)).alias("id"), F.col(f"{s}_emb").alias("e"))
            for s in ("chosen", "rejected")
        ]
    )
    return pairs.select(F.inline(sides)).select("id", S.objective_rewards("e", weights).alias("rewards"))


def gate_rows(pairs: DataFrame, weights: np.ndarray, *keys: str) -> DataFrame:
    """What the gate is fitted on: prompt embeddings and raw rewards of both sides, and the given keys."""
    return pairs.select(
        *keys,
        F.col("chosen_prompt_emb").alias("chosen_prompt"),
        F.col("rejected_prompt_emb").alias("rejected_prompt"),
        S.objective_rewards("chosen_emb", weights).alias("chosen_rewards"),
        S.objective_rewards("rejected_emb", weights).alias("rejected_rewards"),
    )


def fit_mixture(
    labelled: DataFrame,
    attrs: Sequence[str],
    pairs: DataFrame,
    key: str = "id",
    pair_key: str = "pair_id",
    dim: int = K.VERBOSITY_DIM,
    steps: int = 100,
    lr: float = 1e-3,
    temperature: float = 10.0,
    over: str = "objectives",
    reference: DataFrame | None = None,
    hidden: Sequence[int] = (),
    batch: int | None = 1024,
    dropout: float = 0.0,
) -> Mixture:
    """Ridge probes, verbosity penalties and gate.

    The probes are fitted on labelled embeddings, the gate on embedded pairs, of
    which a fifth is left out for `validation_accuracy`; its layers, batches and
    dropout are as in `fit_gate`. The penalties are those
    of the rewards of the `reference` pairs, by default of the same pairs. Pairs
    are written to the shared folder once, since all of this reads them.
    """
    pairs = written(pairs, "pairs")
    reference = pairs if reference is None else reference
    weights = fit.weight_matrix(fit.fit_ridge_probe(labelled, attrs, key), len(attrs))
    table = ranks.verbosity_penalties(pooled_rewards(reference, weights, pair_key), objectives=len(weights), dim=dim)
    penalties = [r["penalty"] for r in table.orderBy("objective").collect()]
    train = train_val_split(pairs, pair_key, 0.2, 0).where(~F.col("is_val"))
    gate = fit.fit_gate(
        gate_rows(train, weights, pair_key), *weights.shape, steps=steps, lr=lr, temperature=temperature, over=over,
        hidden=hidden, batch=batch, key=pair_key, dropout=dropout,
    )
    return Mixture(weights, penalties, gate)


def scored_pairs(pairs: DataFrame, mixture: Mixture, debias: bool = False, dim: int = K.VERBOSITY_DIM) -> DataFrame:
    """Pairs with the mixture score of both sides; raw rewards unless `debias`."""
    g = mixture.gate
    return fit.mixture_pairs(
        pairs, mixture.weights, g.layers, g.temperature, mixture.penalties if debias else None, dim, g.over
    )


def validation_accuracy(pairs: DataFrame, mixture: Mixture, pair_key: str = "pair_id") -> DataFrame:
    """Share of left-out pairs whose chosen side scores higher."""
    held = train_val_split(pairs, pair_key, 0.2, 0).where("is_val")
    return scored_pairs(held, mixture).agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))
