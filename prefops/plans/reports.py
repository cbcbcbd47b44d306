"""Benchmark report and judge run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.functions import scores as S
from prefops.operators import benchmark, judge


def benchmark_report(df: DataFrame, registry: DataFrame, ties: str = "half", decimals: int | None = 2) -> DataFrame:
    """Section scores from two rewards per row (`subset`, `rc`, `rr`)."""
    scored = df.withColumn("correct", S.pair_outcome("rc", "rr", ties))
    return benchmark.section_scores(benchmark.subset_accuracy(scored, registry), decimals)


def report_with_overall(sections: DataFrame, decimals: int = 2) -> DataFrame:
    """Unrounded section scores, rounded, and as one more row their mean, rounded once."""
    total = benchmark.overall_score(sections, decimals).select(F.lit("Score").alias("section"), "score")
    return sections.select("section", F.round("score", decimals).alias("score")).unionByName(total)


def questions_to_ask(df: DataFrame, done: DataFrame, models: DataFrame) -> DataFrame:
    """(model, split, index) and both prompts for every question a usable model has not answered.

    `df` has one row per question and model (`model`, `split`, `index`, `prompt`,
    `response_1`, `response_2`).
    """
    wanted = df.join(models.select("model"), "model", "left_semi")
    left = judge.pending(wanted, done)
    prompts = judge.judge_prompts(
        left.withColumn("_key", F.struct("model", "split", "index")), "_key"
    )
    return prompts.select("_key.*", "prompt_orig", "prompt_swapped")


def judge_run(raw: DataFrame, old: DataFrame) -> DataFrame:
    """New raw answers judged and merged into the old results."""
    return judge.merge_results(old, judge.judge_rows(raw))
