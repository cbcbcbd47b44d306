"""Judge models: which to run, what is left to ask, what they said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.schema import require

RESULT_KEYS = ("model", "split", "index")


def judge_models(spark: SparkSession) -> DataFrame:
    """The registry of judge models as a table."""
    return spark.createDataFrame(
        K.JUDGE_MODELS, "model string, tokens int, size double, vendor string, error string"
    )


def usable_models(
    registry: DataFrame,
    vendor: str = K.DEFAULT_VENDOR,
    max_size: float | None = None,
    names: Sequence[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Models without known errors, of one vendor, below a size.

    With `strict`, a named model that is unknown, of another vendor or too
    large is an error; otherwise it is left out.
    """
    require(registry, "model", "size", "vendor", "error")
    if names is not None and strict:
        known = {r["model"]: r for r in registry.where(F.col("model").isin(*names)).collect()}
        for name in names:
            if name not in known:
                raise ValueError(f"unknown model: {name}")
            if (known[name]["vendor"] or K.DEFAULT_VENDOR) != vendor:
                raise ValueError(f"{name} does not belong to vendor {vendor}")
            if max_size is not None and known[name]["size"] >= max_size:
                raise ValueError(f"{name} is not below {max_size}B")
    out = registry.where(
        F.col("error").isNull() & (F.coalesce("vendor", F.lit(K.DEFAULT_VENDOR)) == vendor)
    )
    if max_size is not None:
        out = out.where(F.col("size") < max_size)
    if names is not None:
        out = out.where(F.col("model").isin(*names))
    return out


def judge_prompts(df: DataFrame, key: str = "index") -> DataFrame:
    """Both orders of the judge prompt: (key, prompt_orig, prompt_swapped)."""
    require(df, key, "prompt", "response_1", "response_2")
    conv = X.parse_multiturn("prompt")
    return df.select(
        key,
        X.judge_prompt(conv, "response_1", "response_2").alias("prompt_orig"),
        X.judge_prompt(conv, "response_1", "response_2", swapped=True).alias("prompt_swapped"),
    )


def judge_rows(df: DataFrame) -> DataFrame:
    """Raw answers in both orders to result rows.

    One failed call marks both stored texts as failed; the verdict of each
    order is still read from its own answer.
    """
    require(df, *RESULT_KEYS, "response_orig", "response_swapped")
    orig, swapped = F.col("response_orig"), F.col("response_swapped")
    failed = (orig == K.API_ERROR) | (swapped == K.API_ERROR)

    def stored(c: Column) -> Column:
        return F.when(failed, F.lit(K.API_ERROR)).otherwise(X.strip(c))

    verdicts = df.withColumns(
        {"preference_orig_order": X.parse_verdict(orig), "preference_swapped_order": X.parse_verdict(swapped)}
    )
    return verdicts.select(
        "split",
        "index",
        "model",
        "preference_orig_order",
        "preference_swapped_order",
        S.consistent_preference("preference_orig_order", "preference_swapped_order").alias("preference"),
        stored(orig).alias("response_orig"),
        stored(swapped).alias("response_swapped"),
    )


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """Rows whose key has no result yet."""
    keys = list(keys)
    require(df, *keys)
    return df.join(require(done, *keys).select(*keys), keys, "left_anti")


def latest_results(df: DataFrame, version: str, keys: Sequence[str] = RESULT_KEYS) -> DataFrame:
    """One row per key, the one of the highest version.

    Of several rows with that version the largest values win, so that the choice
    doesn't depend on the order of rows. `max_by` keeps one candidate per task
    and key before the shuffle, so a key repeated many times costs no more than
    another.
    """
    keys = list(keys)
    require(df, *keys, version)
    values = [c for c in df.columns if c not in keys and c != version]
    newest = F.max_by(F.struct(*values), F.struct(version, *values)).alias("_v")
    return df.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str] = RESULT_KEYS, order: str = "index") -> DataFrame:
    """Old and new results, the newer one where both have a key, sorted by index."""
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    return latest_results(both, "_version", keys).select(*old.columns).orderBy(order)


def judge_summary(df: DataFrame) -> DataFrame:
    """Verdict counts per model, and the share of clear verdicts that follow the position."""
    require(df, "model", "preference_orig_order", "preference_swapped_order", "preference")
    orig, swapped = F.col("preference_orig_order"), F.col("preference_swapped_order")
    clear = orig.isin("A", "B") & swapped.isin("A", "B")

    def said(verdict: str, name: str) -> Column:
        per_order = (orig == verdict).cast("long") + (swapped == verdict).cast("long")
        return F.sum(per_order).alias(name)

    def final(value: int, name: str) -> Column:
        return F.count_if(F.col("preference") == value).alias(name)

    return df.groupBy("model").agg(
        F.count("*").alias("n"),
        said("A", "n_a"),
        said("B", "n_b"),
        said(K.FORMAT_ERROR, "n_format_error"),
        said(K.API_ERROR, "n_api_error"),
        final(-1, "n_first"),
        final(0, "n_none"),
        final(1, "n_second"),
        F.try_divide(F.count_if(clear & (orig == swapped)) * 1.0, F.count_if(clear)).alias("position_bias"),
    )
