"""Losses and statistics as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops.functions import scores as S
from prefops.schema import require


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation as an aggregate; null when either side is constant.

    `F.corr` fails on a constant column in ANSI mode, and a CASE around it does
    not help because the aggregate is computed all the same. Both columns must
    be null in the same rows.
    """
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mse(df: DataFrame, by: Sequence[str] = ("attr", "alpha"), label: str = "label", pred: str = "pred") -> DataFrame:
    """Mean squared error per group over the rows with a label."""
    require(df, *by, label, pred)
    known = df.where(F.col(label).isNotNull())
    return known.groupBy(*by).agg(
        F.avg(F.pow(F.col(label) - F.col(pred), F.lit(2.0))).alias("loss"), F.count("*").alias("n")
    )


def argmin_by_group(df: DataFrame, group: str = "attr", param: str = "alpha", loss: str = "loss") -> DataFrame:
    """The parameter of least loss per group, the smaller one on a tie."""
    require(df, group, param, loss)
    best = F.min_by(F.struct(param, loss), F.struct(loss, param)).alias("_b")
    return df.where(F.col(loss).isNotNull()).groupBy(group).agg(best).select(group, "_b.*")


def length_bias(df: DataFrame, length: str = "length", heads: Sequence[str] = ("head0", "head1")) -> DataFrame:
    """Correlation of length with the reward of each head, and the two losses made of them.

    Head 0 should follow the length (loss 1 - corr), head 1 should not (|corr|).
    """
    require(df, length, *heads)
    rows = df.dropna(subset=[length, *heads])
    return rows.agg(*[pearson(length, h).alias(f"corr_{h}") for h in heads]).withColumns(
        {"loss_follow": 1.0 - F.col(f"corr_{heads[0]}"), "loss_avoid": F.abs(F.col(f"corr_{heads[1]}"))}
    )


def bt_loss(df: DataFrame, chosen: str = "rc", rejected: str = "rr") -> DataFrame:
    """Mean of -log σ(chosen - rejected)."""
    require(df, chosen, rejected)
    return df.agg(F.avg(S.bt_loss_term(chosen, rejected)).alias("loss"), F.count("*").alias("n"))


def bce_loss(df: DataFrame, label: str = "label", logit: str = "logit") -> DataFrame:
    """Mean binary cross entropy of a logit."""
    require(df, label, logit)
    return df.agg(F.avg(S.bce_term(label, logit)).alias("loss"), F.count("*").alias("n"))


def two_head_loss(df: DataFrame, by: str = "batch", weight: float = 1.0, per_pair: bool = False) -> DataFrame:
    """Ranking loss plus length losses of a two-head model, per batch.

    Rows are pairs with `length_chosen`, `length_rejected` and arrays `chosen`,
    `rejected` of two head rewards. The ranking term is -log σ of the difference
    of the sums over the batch and both heads; `per_pair` takes the mean over
    pairs of the summed heads instead.
    """
    require(df, by, "length_chosen", "length_rejected", "chosen", "rejected")

    def sides(s: str) -> Column:
        heads = F.col(s)
        return F.struct(
            F.lit(s).alias("side"),
            F.col(f"length_{s}").cast("double").alias("length"),
            F.get(heads, F.lit(0)).cast("double").alias("h0"),
            F.get(heads, F.lit(1)).cast("double").alias("h1"),
        )

    gap = sum(F.get("chosen", F.lit(h)) - F.get("rejected", F.lit(h)) for h in (0, 1))
    one_pair = S.bt_loss_term(gap, F.lit(0.0))
    rows = df.select(
        by, gap.alias("gap"), one_pair.alias("one_pair"), F.explode(F.array(sides("chosen"), sides("rejected"))).alias("s")
    ).select(by, "gap", "one_pair", "s.*")
    on_chosen = F.col("side") == "chosen"
    sums = rows.groupBy(by).agg(
        F.count_if(on_chosen).alias("n"),
        F.sum(F.when(on_chosen, F.col("gap"))).alias("_gap"),
        F.avg(F.when(on_chosen, F.col("one_pair"))).alias("_mean"),
        pearson("length", "h0").alias("_c0"),
        pearson("length", "h1").alias("_c1"),
    )
    ranking = F.col("_mean") if per_pair else S.bt_loss_term(F.col("_gap"), F.lit(0.0))
    follow, avoid = 1.0 - F.col("_c0"), F.abs(F.col("_c1"))
    return sums.select(
        by,
        "n",
        ranking.alias("ranking_loss"),
        follow.alias("loss_follow"),
        avoid.alias("loss_avoid"),
        (ranking + F.lit(float(weight)) * (follow + avoid)).alias("loss"),
    )
