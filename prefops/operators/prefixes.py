"""Dialogues that begin alike: every beginning is one node, scored once.

The answers of a question share their first steps, and a step is scored on all turns
before it. Each beginning gets the digest of the one before and of its last turn,
so equal beginnings have equal ids, whatever answer they are in. A model that
scores turn by turn reads the nodes; one that scores all turns of a dialogue in a
pass reads those dialogues that no other one continues. Either way the scores come
back to the steps of all answers by a join on the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefops.functions import text as X
from prefops.operators.steps import ANSWER_KEYS
from prefops.schema import require


def _turns(df: DataFrame, model_type: str, keys: Sequence[str]) -> DataFrame:
    """Answers with the texts of their user turns and the ids of their beginnings. Steps of null answers are none."""
    require(df, *keys, "prompt", "answer")
    steps = X.split_steps("answer", model_type)
    texts = F.transform(steps, lambda t, i: F.when(i == 0, F.concat("prompt", F.lit(" "), t)).otherwise(t))
    rows = df.select(*keys, texts.alias("texts")).where("texts is not null and not exists(texts, t -> t is null)")
    return rows.withColumn("ids", _chained(F.col("texts")))


def _chained(texts: Column) -> Column:
    """The digest of every beginning of a list of texts."""

    def step(last: Column, text: Column) -> Column:
        return F.sha2(F.encode(F.concat(F.coalesce(last, F.lit("")), F.lit("\n"), text), "UTF-8"), 256)

    return running(texts, "string", step)


def running(values: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """For every element of a list the `step` of the result before, null at first, and of the element; one step an element."""
    return F.aggregate(values, F.array().cast(f"array<{kind}>"), lambda done, x: F.array_append(done, step(F.get(done, F.size(done) - 1), x)))


def _rows(turns: DataFrame, keys: Sequence[str]) -> DataFrame:
    parents = F.concat(F.array(F.lit(None).cast("string")), F.slice("ids", F.lit(1), F.size("ids") - 1))
    each = F.arrays_zip(F.col("ids").alias("id"), parents.alias("parent"), F.col("texts").alias("text"))
    return turns.where(F.size("texts") > 0).select(*keys, F.posexplode(each).alias("step", "_z")).select(*keys, "step", "_z.*")


def prefix_members(df: DataFrame, model_type: str = "Mistral", keys: Sequence[str] = ANSWER_KEYS) -> DataFrame:
    """(keys, step, id): which beginning every step of an answer ends."""
    return _rows(_turns(df, model_type, keys), keys).select(*keys, "step", "id")


def prefix_nodes(df: DataFrame, model_type: str = "Mistral", keys: Sequence[str] = ANSWER_KEYS) -> DataFrame:
    """(id, parent, step, text): every different beginning once, with its last turn only; `parent` is null at the first turn.

    So there is as much text as there are different turns after different
    beginnings. Turns with one id are compared; a difference is an error.
    """
    rows = _rows(_turns(df, model_type, keys), keys)
    same = rows.groupBy("id").agg(*(f(c).alias(f"{c}_{k}") for c in ("parent", "step", "text") for k, f in (("lo", F.min), ("hi", F.max))))
    equal = F.lit(True)
    for c in ("parent", "step", "text"):
        equal = equal & F.col(f"{c}_lo").eqNullSafe(F.col(f"{c}_hi"))
    text = F.when(equal, F.col("text_lo")).otherwise(F.raise_error(F.lit("two beginnings share an id")).cast("string"))
    return same.select("id", F.col("parent_lo").alias("parent"), F.col("step_lo").alias("step"), text.alias("text"))


def whole_dialogues(df: DataFrame, model_type: str = "Mistral", keys: Sequence[str] = ANSWER_KEYS) -> DataFrame:
    """(ids, dialogue): the different dialogues that no other one continues, each once, with the ids of their user turns."""
    turns = _turns(df, model_type, keys).where(F.size("texts") > 0)
    last = F.element_at("ids", -1)
    inner = _rows(turns, keys).where("parent is not null").select(F.col("parent").alias("_inner")).distinct()
    # Only ids are compared; of equal dialogues any one is as good.
    ends = turns.select(last.alias("_last"), "ids", "texts").join(inner, F.col("_last") == F.col("_inner"), "left_anti")
    one = ends.groupBy("_last").agg(F.any_value(F.struct("ids", "texts")).alias("_one"))
    dialogue = F.flatten(F.transform("_one.texts", lambda t: X.user_assistant(t, F.lit("+"))))
    return one.select("_one.ids", dialogue.alias("dialogue"))


def scores_of_steps(members: DataFrame, scores: DataFrame) -> DataFrame:
    """The step rows with the score columns of their beginnings, from (id, score columns) or lists of them per dialogue.

    `scores` may hold `ids` with lists as long as they are in place of one id per
    row. A beginning that several dialogues score takes one of them.
    """
    names = [c for c in scores.columns if c not in ("id", "ids")]
    if "ids" in scores.columns:
        zipped = F.arrays_zip(F.col("ids").alias("id"), *names)
        scores = scores.select(F.explode(zipped).alias("_z")).select("_z.*")
    one = scores.groupBy("id").agg(F.min(F.struct(*names)).alias("_s"))
    return members.join(one, "id", "left").select(*(c for c in members.columns if c != "id"), "_s.*")
