"""Choosing one of many answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops.schema import require


def best_of_n(df: DataFrame, n: int | None = None, key: str = "q_id", score: str = "score") -> DataFrame:
    """Best-scored of the first n answers, the earlier one on a tie, and whether it is correct.

    An aggregate, not a window: a task keeps one candidate per question, so a
    question with very many answers is not gathered anywhere.
    """
    require(df, key, "ans_idx", score, "label")
    kept = df if n is None else df.where(F.col("ans_idx") < n)
    best = F.max_by(F.struct("ans_idx", score, "label"), F.struct(F.col(score), -F.col("ans_idx")))
    return (
        kept.groupBy(key)
        .agg(best.alias("_b"))
        .select(key, "_b.ans_idx", F.col(f"_b.{score}").alias(score), (F.col("_b.label") == 1).alias("correct"))
    )


def pass_at_1(df: DataFrame, key: str = "q_id") -> DataFrame:
    """Mean label of the answers of each question."""
    require(df, key, "label")
    return df.groupBy(key).agg(F.avg(F.col("label").cast("double")).alias("pass_at_1"))


def majority_vote(df: DataFrame, key: str = "q_id", answer: str = "final_answer") -> DataFrame:
    """Most frequent final answer; on a tie the one given first."""
    require(df, key, answer, "ans_idx")
    votes = df.groupBy(key, answer).agg(
        F.count("*").alias("votes"), F.min("ans_idx").alias("_first"), F.min_by("label", "ans_idx").alias("_label")
    )
    won = F.max_by(F.struct(answer, "votes", "_label"), F.struct(F.col("votes"), -F.col("_first")))
    return (
        votes.groupBy(key)
        .agg(won.alias("_w"))
        .select(key, f"_w.{answer}", "_w.votes", (F.col("_w._label") == 1).alias("correct"))
    )


def tournament(
    df: DataFrame,
    prob_a: Callable[[Column, Column], Column] | Callable[[DataFrame], DataFrame],
    key: str = "q_id",
    batch: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Best answer of every question by knock-out matches, n - 1 of them for n answers.

    In each round the answers at places 2i and 2i+1 meet and the winner goes on;
    one left over goes on unopposed, and A wins at probability one half. A match
    involves two rows, so no question is gathered into one task.

    `prob_a(a, b)` gives the probability that answer a wins from the two answer
    structs. With `batch`, `prob_a(matches)` takes the frame of one round with
    structs `a` and `b` and returns it with a column `prob_a`, for a model that
    scores batches of rows. An unopposed answer has a null opponent there and
    goes on whatever its `prob_a`.

    `columns` names what a match looks at besides the key and `ans_idx`. Only
    these move from round to round; the winners' other columns are joined at the
    end by key and `ans_idx`, which must be unique.
    """
    require(df, key, "ans_idx")
    names = df.columns if columns is None else list(dict.fromkeys([key, "ans_idx", *columns]))
    last = df.agg(F.max("ans_idx")).first()[0] or 0
    rounds = int(last).bit_length()
    live = df.select(key, F.col("ans_idx").cast("long").alias("_at"), F.struct(*names).alias("_row"))
    for _ in range(rounds):
        at_a = F.col("_at") % 2 == 0
        matches = live.groupBy(key, F.shiftright("_at", 1).alias("_at")).agg(
            F.any_value(F.when(at_a, F.col("_row")), ignoreNulls=True).alias("a"),
            F.any_value(F.when(~at_a, F.col("_row")), ignoreNulls=True).alias("b"),
        )
        met = prob_a(matches) if batch else matches.withColumn("prob_a", prob_a(F.col("a"), F.col("b")))
        live = met.select(
            key,
            "_at",
            F.when(F.col("b").isNull(), F.col("a"))
            .when(F.col("a").isNull(), F.col("b"))
            .when(F.col("prob_a") >= 0.5, F.col("a"))
            .otherwise(F.col("b"))
            .alias("_row"),
        )
    won = live.select("_row.*")
    return won if columns is None else df.join(won.select(key, "ans_idx"), [key, "ans_idx"], "left_semi")
