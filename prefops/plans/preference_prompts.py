"""From preference data to pairwise prompts: supervised, semi-supervised and augmented."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.operators import augment, pairs
from prefops.schema import require


def supervised_prompts(sources: Mapping[str, DataFrame], key: str = "pair_id", seed: int = 42) -> DataFrame:
    """Valid pairs of all sources as shuffled pairwise prompts."""
    return pairs.combine(sources, key, seed)


def with_prompt_length(df: DataFrame, tokenizer: Callable | None = None) -> DataFrame:
    """Add `length`, the tokens of the pairwise prompt with the chosen answer first."""
    require(df, "chosen", "rejected")
    prompt = X.pairwise_prompt_text(
        X.render_turns(X.context_of("chosen")), X.last_content("chosen"), X.last_content("rejected")
    )
    return df.withColumn("length", X.token_length(prompt, tokenizer))


def with_chosen_prob(df: DataFrame, a1: str, b1: str, a2: str, b2: str, temperature: float = 1.0) -> DataFrame:
    """Add `chosen_prob` from the logits of both orders."""
    require(df, a1, b1, a2, b2)
    return df.withColumn("chosen_prob", S.debiased_prob(a1, b1, a2, b2, temperature))


def pseudo_labelled_prompts(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    key: str = "pair_id",
    max_len: int = K.MAX_PROMPT_TOKENS,
    threshold: float = 0.8,
    relabel: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Valid pairs that are short enough and that a model is sure about, as prompts.

    `score` adds `chosen_prob`. The length filter comes before it, since the
    optimizer does not move filters across a model call.
    """
    short = pairs.length_at_most(with_prompt_length(pairs.valid_pairs(df)), max_len)
    return pairs.pair_prompt(pairs.confident_pairs(score(short), threshold, relabel), key, seed)


def augmented_prompts(df: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """Fourteen new prompts per prompt."""
    return augment.augment_prompts(df, key, seed)


def reject_counts(df: DataFrame) -> DataFrame:
    """Pairs per first broken rule; valid pairs under null."""
    return pairs.pair_reject_reason(df).groupBy("reject_reason").agg(F.count("*").alias("n"))


def share_confident(df: DataFrame, threshold: float = 0.8, prob: str | Column = "chosen_prob") -> DataFrame:
    """How many pairs the confidence threshold keeps."""
    return pairs.keep_rate(df, S.confidence(prob) > threshold)
