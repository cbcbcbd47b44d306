"""Preference pairs: lifting, checking, filtering, pairing and un-pairing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.functions.rand import coin
from prefops.operators.ordering import shuffle_index
from prefops.schema import require
from prefops.sources.io import written


def to_standard_pairs(df: DataFrame) -> DataFrame:
    """Prompt and two answers as strings become two conversations."""
    require(df, "prompt", "chosen", "rejected")
    kept = [c for c in df.columns if c not in ("prompt", "chosen", "rejected")]
    return df.select(
        *kept,
        X.user_assistant(F.col("prompt"), F.col("chosen")).alias("chosen"),
        X.user_assistant(F.col("prompt"), F.col("rejected")).alias("rejected"),
    )


def _roles_alternate(conv: Column) -> Column:
    expected = F.transform(
        conv, lambda m, i: m["role"] == F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    )
    return F.forall(expected, lambda ok: F.coalesce(ok, F.lit(False)))


def _has_empty(conv: Column) -> Column:
    return F.exists(conv, lambda m: F.coalesce(m["content"], F.lit("")) == "")


def _contents(conv: Column) -> Column:
    return F.transform(conv, lambda m: m["content"])


def reject_reason(chosen: str | Column = "chosen", rejected: str | Column = "rejected") -> Column:
    """First rule a pair breaks, or null for a valid pair."""
    c = F.col(chosen) if isinstance(chosen, str) else chosen
    r = F.col(rejected) if isinstance(rejected, str) else rejected
    return (
        F.when(c.isNull() | r.isNull() | (F.size(c) == 0) | (F.size(r) == 0), F.lit("empty"))
        .when((F.size(c) % 2 != 0) | (F.size(r) % 2 != 0), F.lit("odd_length"))
        .when(F.size(c) != F.size(r), F.lit("length_differs"))
        .when(~(_roles_alternate(c) & _roles_alternate(r)), F.lit("roles"))
        .when(_has_empty(c) | _has_empty(r), F.lit("empty_content"))
        .when(_contents(X.context_of(c)) != _contents(X.context_of(r)), F.lit("context_differs"))
    )


def valid_pairs(df: DataFrame) -> DataFrame:
    """Pairs of alternating user/assistant turns that differ in the last turn only."""
    require(df, "chosen", "rejected")
    return df.where(reject_reason().isNull())


def pair_reject_reason(df: DataFrame) -> DataFrame:
    """Add the first broken rule as `reject_reason`."""
    require(df, "chosen", "rejected")
    return df.withColumn("reject_reason", reject_reason())


def length_at_most(df: DataFrame, max_len: int = K.MAX_PROMPT_TOKENS, len_col: str = "length") -> DataFrame:
    require(df, len_col)
    return df.where(F.col(len_col) <= max_len)


def both_sides_within(
    df: DataFrame, seq_len: int = K.MAX_SEQUENCE_TOKENS, chosen_len: str = "chosen_len", rejected_len: str = "rejected_len"
) -> DataFrame:
    """Drop the whole pair when either side is too long."""
    require(df, chosen_len, rejected_len)
    return df.where((F.col(chosen_len) <= seq_len) & (F.col(rejected_len) <= seq_len))


def length_stats(df: DataFrame, max_len: int = K.MAX_PROMPT_TOKENS, len_col: str = "length") -> DataFrame:
    """Rows, largest and mean length before the length filter, and rows after it."""
    require(df, len_col)
    return df.agg(
        F.count("*").alias("n"),
        F.max(len_col).alias("max_length"),
        F.avg(len_col).alias("mean_length"),
        F.count_if(F.col(len_col) <= max_len).alias("n_kept"),
    )


def confident_pairs(
    df: DataFrame, threshold: float = 0.8, relabel: bool = False, prob: str = "chosen_prob"
) -> DataFrame:
    """Pairs whose model probability is above the threshold on either side.

    A confident pair keeps its order even when the model prefers the rejected
    answer; `relabel` swaps the sides of such a pair and its probability.
    """
    require(df, prob)
    kept = df.where(S.confidence(prob) > threshold)
    if not relabel:
        return kept
    require(df, "chosen", "rejected")
    flip = F.col(prob) < 0.5
    return kept.withColumns(
        {
            "chosen": F.when(flip, F.col("rejected")).otherwise(F.col("chosen")),
            "rejected": F.when(flip, F.col("chosen")).otherwise(F.col("rejected")),
            prob: F.when(flip, 1.0 - F.col(prob)).otherwise(F.col(prob)),
        }
    )


def keep_rate(df: DataFrame, mask: Column) -> DataFrame:
    """Rows kept by `mask` and their share in percent."""
    kept = F.count_if(mask)
    return df.agg(
        F.count("*").alias("n"),
        kept.alias("n_kept"),
        F.round(F.try_divide(kept * 100.0, F.count("*")), 2).alias("pct_kept"),
    )


def debiased_preference(
    df: DataFrame, keys: Sequence[str] | str = "id", prob: str = "prob_chosen", orders: int = 2
) -> DataFrame:
    """Mean probability of the chosen answer over the stored orders of a pair.

    A pair that has not exactly `orders` probabilities isn't debiased: null.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    require(df, *keys, prob)
    return (
        df.groupBy(*keys)
        .agg(F.when(F.count(prob) == orders, F.avg(prob)).alias("chosen_prob"))
        .withColumn("preference", S.preference_from_prob("chosen_prob"))
    )


def pair_prompt(df: DataFrame, key: str = "pair_id", seed: int | str = 0, keep: Sequence[str] = ()) -> DataFrame:
    """A pairwise prompt with the chosen answer at a random side, and its label."""
    require(df, key, "chosen", "rejected", *keep)
    at_b = coin(seed, key) == 1
    good, bad = X.last_content("chosen"), X.last_content("rejected")
    prompt = X.pairwise_prompt_text(
        X.render_turns(X.context_of("chosen")),
        F.when(at_b, bad).otherwise(good),
        F.when(at_b, good).otherwise(bad),
    )
    label = F.when(at_b, F.lit("B")).otherwise(F.lit("A"))
    return df.select(key, *keep, X.user_assistant(prompt, label).alias("messages"))


def combine(sources: Mapping[str, DataFrame], key: str = "pair_id", seed: int | str = 42) -> DataFrame:
    """Valid pairs of every source as prompts, in one shuffled bag.

    A row is known by its source and its key there, so equal keys of two
    sources stay apart. The bag is written to the shared folder before it is
    shuffled, because its order is drawn from its keys alone.
    """
    parts = [
        pair_prompt(valid_pairs(df), key, f"{seed}:{name}").select(
            F.concat_ws(":", F.lit(name), F.col(key).cast("string")).alias("row_id"), "messages"
        )
        for name, df in sources.items()
    ]
    bag = parts[0]
    for part in parts[1:]:
        bag = bag.unionByName(part)
    return shuffle_index(written(bag, "bag"), "row_id", seed)


def unpivot_pairs(
    df: DataFrame, key: str = "pair_id", order: Sequence[str] = ("chosen", "rejected")
) -> DataFrame:
    """Two rows per pair: (key, position, side, label, value), in the given order of sides."""
    require(df, key, "chosen", "rejected")
    if sorted(order) != ["chosen", "rejected"]:
        raise ValueError(order)
    kept = [c for c in df.columns if c not in ("chosen", "rejected")]
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                F.lit(int(side == "chosen")).alias("label"),
                F.col(side).alias("value"),
            )
            for side in order
        ]
    )
    return df.select(*kept, F.posexplode(sides).alias("position", "_s")).select(*kept, "position", "_s.*")


def repivot_pairs(df: DataFrame, key: str = "pair_id", value: str = "value") -> DataFrame:
    """Back from two rows per pair to one."""
    require(df, key, "side", value)

    def side(s: str) -> Column:
        return F.any_value(F.when(F.col("side") == s, F.col(value)), ignoreNulls=True).alias(s)

    return df.groupBy(key).agg(side("chosen"), side("rejected"))


def attach_scores(df: DataFrame, scores: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """Scores joined to rows by key. Rows without a score drop out of an inner join."""
    require(df, key)
    require(scores, key)
    return df.join(scores, key, how)
