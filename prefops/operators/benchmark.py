"""Benchmark accuracy by subset, section and overall."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.schema import require


def benchmark_registry(spark: SparkSession, counts: Mapping[str, int] | None = None) -> DataFrame:
    """Subsets with section and example count; `counts` replaces some of the counts."""
    rows = [(i, s, sec, (counts or {}).get(s, n)) for i, (s, sec, n) in enumerate(K.BENCHMARK_SUBSETS)]
    return spark.createDataFrame(rows, "subset_id int, subset string, section string, example_count int")


def subset_accuracy(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Mean of `correct` and number of rows that have one, for every subset of the registry; null for none.

    A subset that isn't in the registry is an error; see `unregistered`.
    """
    require(df, "subset", "correct")
    # The aggregate has as many rows as there are subsets, so the join is local to it.
    measured = df.groupBy(F.coalesce("subset", F.lit("")).alias("subset")).agg(F.avg("correct").alias("accuracy"), F.count("correct").alias("n"))
    known = registry.select("subset", "section", "example_count")
    unknown = F.raise_error(F.concat(F.lit("subset not in the registry: "), F.col("subset"))).cast("string")
    return known.join(measured, "subset", "full").select(
        F.coalesce("section", unknown).alias("section"), "subset", "example_count", F.coalesce("n", F.lit(0)).alias("n"), "accuracy"
    )


def unregistered(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of subsets that the registry doesn't have, those without a subset among them."""
    require(df, "subset")
    return df.join(registry.select("subset"), "subset", "left_anti")


def section_scores(accuracy: DataFrame, decimals: int | None = 2) -> DataFrame:
    """Accuracy in percent per section, weighted by example count over the subsets present; 0 for none."""
    require(accuracy, "section", "accuracy", "example_count")
    weight = F.when(F.col("accuracy").isNotNull(), F.col("example_count"))
    score = F.coalesce(
        F.try_divide(F.sum(F.col("accuracy") * weight) * 100, F.sum(weight)), F.lit(0.0)
    )
    return accuracy.groupBy("section").agg(
        (score if decimals is None else F.round(score, decimals)).alias("score")
    )


def overall_score(sections: DataFrame, decimals: int = 2) -> DataFrame:
    """Mean of the section scores, each with the same weight; of unrounded ones, so that only the mean is rounded."""
    require(sections, "score")
    return sections.agg(F.round(F.avg("score"), decimals).alias("score"))


def mean_accuracy(df: DataFrame, correct: str | Column = "correct") -> DataFrame:
    """Share of correct rows."""
    c = F.col(correct) if isinstance(correct, str) else correct
    return df.agg(F.avg(c.cast("double")).alias("accuracy"), F.count(c).alias("n"))
