"""Augmentation of preference triples with answers of foreign contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops.functions import text as X
from prefops.functions.rand import coin
from prefops.operators.ordering import dense_index
from prefops.schema import require
from prefops.sources.io import written


def _parsed(df: DataFrame) -> DataFrame:
    messages = F.col("messages")
    return df.withColumn("_p", X.prompt_parts(F.get(messages, F.lit(0))["content"])).withColumn(
        "_l", F.get(messages, F.lit(1))["content"]
    )


def _well_formed() -> Column:
    return F.coalesce((F.size("_p") == 3) & F.col("_l").isin("A", "B", "Same"), F.lit(False))


def parse_pair_prompt(df: DataFrame, key: str = "id") -> DataFrame:
    """Pairwise prompts back to (key, context, response_w, response_l, neutral).

    Blanks around the parts are kept. Rows that do not parse are left out here
    and found with `unparsed_prompts`.
    """
    require(df, key, "messages")
    part = lambda i: F.get("_p", F.lit(i))
    b_wins = F.col("_l") == "B"
    return (
        _parsed(df)
        .where(_well_formed())
        .select(
            key,
            part(0).alias("context"),
            F.when(b_wins, part(2)).otherwise(part(1)).alias("response_w"),
            F.when(b_wins, part(1)).otherwise(part(2)).alias("response_l"),
            (F.col("_l") == "Same").alias("neutral"),
        )
    )


def unparsed_prompts(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows that `parse_pair_prompt` leaves out."""
    require(df, key, "messages")
    return _parsed(df).where(~_well_formed()).drop("_p", "_l")


def render_triple(df: DataFrame, *key: str, seed: int | str = 0) -> DataFrame:
    """Triples to pairwise prompts with the winner at a random side."""
    require(df, *key, "context", "response_w", "response_l", "neutral")
    w_first = coin(seed, *key) == 1
    w, l = F.col("response_w"), F.col("response_l")
    prompt = X.joined_prompt_text(
        F.col("context"), F.when(w_first, w).otherwise(l), F.when(w_first, l).otherwise(w)
    )
    label = F.when(F.col("neutral"), F.lit("Same")).when(w_first, F.lit("A")).otherwise(F.lit("B"))
    return df.select(*key, X.user_assistant(prompt, label).alias("messages"))


def partners(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Two random partners for every key: (key, id_j, id_k), each a permutation of the keys."""
    ids = df.select(key)
    i = dense_index(ids, key, f"{seed}:i", name="_at")
    j = dense_index(ids, key, f"{seed}:j", name="_at").withColumnRenamed(key, "id_j")
    k = dense_index(ids, key, f"{seed}:k", name="_at").withColumnRenamed(key, "id_k")
    return i.join(j, "_at").join(k, "_at").drop("_at")


def augment_triples(df: DataFrame, key: str = "id", seed: int | str = 0) -> DataFrame:
    """Fourteen new triples per row: (key, slot, context, response_w, response_l, neutral).

    With partners j and k of row i: both answers of i beat each of the four
    foreign answers (slots 0-7), and the foreign answers tie with each other
    (slots 8-13). The row itself is not repeated, and a row may be its own
    partner.

    The permutations run on keys only. Texts move once by their own key, a
    shuffle both readers share, and once to the row they are partnered with; the
    fourteen rows are built after the last join. `df` is read several times,
    mostly for its key alone, so it should be a table and not a long plan.
    """
    require(df, key, "context", "response_w", "response_l")
    drawn = partners(df, key, seed)
    answers = df.select(F.col(key).alias("_id"), F.struct("response_w", "response_l").alias("_a"))

    def of(partner: str) -> DataFrame:
        met = drawn.select(key, F.col(partner).alias("_id")).join(answers, "_id")
        return met.select(key, F.col("_a").alias(partner))

    wide = df.select(key, "context", "response_w", "response_l").join(of("id_j"), key).join(of("id_k"), key)
    wi, li = F.col("response_w"), F.col("response_l")
    wj, lj = F.col("id_j.response_w"), F.col("id_j.response_l")
    wk, lk = F.col("id_k.response_w"), F.col("id_k.response_l")
    decided = [(mine, other) for mine in (wi, li) for other in (wj, wk, lj, lk)]
    tied = [(wj, lj), (wk, lk), (wj, wk), (wj, lk), (wk, lj), (lj, lk)]
    rows = [(w, l, False) for w, l in decided] + [(w, l, True) for w, l in tied]
    slots = F.array(
        *[
            F.struct(w.alias("response_w"), l.alias("response_l"), F.lit(neutral).alias("neutral"))
            for w, l, neutral in rows
        ]
    )
    return wide.select(key, "context", F.posexplode(slots).alias("slot", "_t")).select(
        key, "slot", "context", "_t.*"
    )


def augment_prompts(df: DataFrame, key: str = "id", seed: int | str = 0) -> DataFrame:
    """Pairwise prompts in, fourteen augmented pairwise prompts per parsed row out.

    The parsed rows are written to the shared folder once.
    """
    triples = written(parse_pair_prompt(df, key), "triples")
    return render_triple(augment_triples(triples, key, seed), key, "slot", seed=seed)
