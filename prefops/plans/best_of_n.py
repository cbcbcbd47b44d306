"""Accuracy of the best of N answers under step or outcome scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.operators import benchmark, ranking, steps
from prefops.schema import require
from prefops.sources.once import write_once


def step_scored(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], n: int | None = None, model_type: str = "Mistral"
) -> DataFrame:
    """Answers with the mean of their step scores, all of them or the first n of each question.

    An answer without steps, such as a null one, stays with a null score.
    `score` takes step rows and adds the logits of "+" and "-" as `plus` and `minus`.
    """
    answers = df if n is None else steps.first_n_answers(df, n)
    scored = score(steps.step_rows(answers, model_type)).withColumn("score", S.softmax_pair("plus", "minus"))
    means = steps.answer_scores(scored)
    return answers.select("q_id", "ans_idx", "label").join(means, ["q_id", "ans_idx"], "left")


def outcome_scored(
    df: DataFrame, score: Callable[[DataFrame], DataFrame], n: int | None = None, model_type: str = "Mistral"
) -> DataFrame:
    """Answers with the single score of their one-turn dialogue, all of them or the first n of each question."""
    answers = df if n is None else steps.first_n_answers(df, n)
    asked = answers.select(
        "q_id", "ans_idx", "label", F.get(X.orm_dialogue("prompt", "answer", model_type), F.lit(0))["content"].alias("text")
    )
    return score(asked).withColumn("score", S.softmax_pair("plus", "minus")).select("q_id", "ans_idx", "label", "score")


QUESTION_SCHEMA = "q_id long, answers array<string>, label array<int>, step_scores array<array<double>>"


def question_records(answers: DataFrame, step_scores: DataFrame) -> DataFrame:
    """One row per question: answers, label and step_scores, all in the order of ans_idx.

    `answers` has one row per answer, `step_scores` (q_id, ans_idx, step, score)
    one per step. An answer without steps has an empty list of scores. A question
    is a record: it is held in one row.
    """
    require(answers, "q_id", "ans_idx", "answer", "label")
    require(step_scores, "q_id", "ans_idx", "step", "score")
    per_answer = step_scores.groupBy("q_id", "ans_idx").agg(F.array_sort(F.collect_list(F.struct("step", "score"))).alias("_s"))
    rows = answers.select("q_id", "ans_idx", "answer", "label").join(per_answer, ["q_id", "ans_idx"], "left")
    scores = F.coalesce(F.col("_s.score"), F.array().cast("array<double>"))
    whole = rows.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("ans_idx", "answer", "label", scores.alias("scores")))).alias("_a"))
    return whole.select("q_id", F.col("_a.answer").alias("answers"), F.col("_a.label").alias("label"), F.col("_a.scores").alias("step_scores"))


def write_accuracy(scored: DataFrame, path: str, run: str, job: str | None = None) -> None:
    """Append the accuracy of a run: (run, accuracy, n), one row; that of a named `job` once however often it runs."""
    row = accuracy(scored).select(F.lit(run).alias("run"), "accuracy", "n")
    if job is not None:
        write_once(row, path, job)
    else:
        row.write.mode("append").parquet(path)


def accuracy(scored: DataFrame) -> DataFrame:
    """Share of questions whose best-scored answer is correct."""
    return benchmark.mean_accuracy(ranking.best_of_n(scored))
