"""Step-wise answers: step rows, labels and training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions import text as X
from prefops.schema import require

ANSWER_KEYS = ("q_id", "ans_idx")


def explode_answers(df: DataFrame, key: str = "q_id") -> DataFrame:
    """Questions with answer arrays to one row per answer."""
    require(df, key, "answers", "label")
    rest = [c for c in df.columns if c not in ("answers", "label")]
    zipped = F.arrays_zip(F.col("answers").alias("answer"), F.col("label").alias("label"))
    return df.select(*rest, F.posexplode(zipped).alias("ans_idx", "_z")).select(*rest, "ans_idx", "_z.*")


def first_n_answers(df: DataFrame, n: int) -> DataFrame:
    """The first n answers of every question, for answer rows or for answer arrays."""
    if "ans_idx" in df.columns:
        return df.where(F.col("ans_idx") < n)
    require(df, "answers")
    return df.withColumns({c: F.slice(c, 1, n) for c in ("answers", "label") if c in df.columns})


def step_rows(df: DataFrame, model_type: str = "Mistral", keys: Sequence[str] = ANSWER_KEYS) -> DataFrame:
    """One row per step with the text of its user turn; the first step carries the prompt.

    Step k is scored on the turns of steps 0..k. A model that reads a whole
    dialogue scores all of them in one pass; `prefix_dialogues` writes the
    prefixes out for one that cannot.
    """
    require(df, *keys, "prompt", "answer")
    steps = X.split_steps("answer", model_type)
    return (
        df.select(*keys, "prompt", F.posexplode(steps).alias("step", "_t"))
        .withColumn(
            "text", F.when(F.col("step") == 0, F.concat("prompt", F.lit(" "), "_t")).otherwise(F.col("_t"))
        )
        .select(*keys, "step", "text")
    )


def prefix_dialogues(df: DataFrame, model_type: str = "Mistral", keys: Sequence[str] = ANSWER_KEYS) -> DataFrame:
    """One row per step with the dialogue up to and including that step."""
    require(df, *keys, "prompt", "answer")
    whole = df.select(
        *keys, X.prm_dialogue("prompt", X.split_steps("answer", model_type)).alias("dialogue")
    )
    ends = F.sequence(F.lit(0), (F.size("dialogue") / 2).cast("int") - 1)
    return whole.select(*keys, F.explode(ends).alias("step"), "dialogue").select(
        *keys, "step", F.slice("dialogue", F.lit(1), (F.col("step") + 1) * 2).alias("dialogue")
    )


def answer_scores(df: DataFrame, score: str = "score", keys: Sequence[str] = ANSWER_KEYS) -> DataFrame:
    """Mean step score per answer, from step rows."""
    require(df, *keys, score)
    return df.groupBy(*keys).agg(F.avg(score).alias("score"))


def orm_training_row(df: DataFrame, exact: bool = False, strict: bool = True) -> DataFrame:
    """Signed conversations to (question, answer, label).

    The text is cut at every "Step 1" and the second piece is the answer, so an
    answer that reaches "Step 10" ends there. `exact` cuts at the first marker
    only. A text without a marker or a sign other than + and - is an error, or
    null when not `strict`.
    """
    require(df, "conversations")
    text = F.get("conversations", F.lit(0))["content"]
    parts = F.split(text, K.STEP_MARK, 2 if exact else -1)
    tail = F.get(parts, F.lit(1))
    if strict:
        tail = F.coalesce(tail, F.raise_error(F.lit("no step marker")).cast("string"))
    sign = F.get("conversations", F.lit(1))["content"]
    rest = [c for c in df.columns if c != "conversations"]
    return df.select(
        *rest,
        F.get(parts, F.lit(0)).alias("question"),
        F.concat(F.lit(K.STEP_MARK), tail).alias("answer"),
        X.parse_sign(sign, strict).alias("label"),
    )


def hard_step_labels(df: DataFrame, keys: Sequence[str] = ("traj", "step")) -> DataFrame:
    """A step is "+" when any of its completions is correct, else "-"."""
    require(df, *keys, "correct")
    any_correct = F.max(F.col("correct").cast("int")) == 1
    return df.groupBy(*keys).agg(F.when(any_correct, F.lit("+")).otherwise(F.lit("-")).alias("sign"))


def orm_from_prm(df: DataFrame, key: str = "traj", glue: str = "\n") -> DataFrame:
    """Step rows to one row per trajectory: its steps in order, and the sign of the last."""
    require(df, key, "step", "text", "sign")
    ordered = F.array_sort(F.collect_list(F.struct("step", "text")))
    return df.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), glue).alias("text"),
        F.max_by("sign", "step").alias("sign"),
    )
