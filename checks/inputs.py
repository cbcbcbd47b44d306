"""Inputs of the operators, derived from the given tables in Spark and in SQL.

Every input has a function (spark, sf_dir) -> DataFrame and a SQL common table
expression of the same rows and columns. Both draw their random choices from
the md5 of a key, so neither engine needs the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import sql_hash as H
from checks.base import sql_text
from prefops import constants as K
from prefops.functions import text as X
from prefops.functions.rand import portable_hash
from prefops.operators.ordering import dense_index
from prefops.sources import io


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return io.read_split(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Flat pairs: a document of good quality against one of bad quality, under a prompt.


def flat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners are found on keys; each text is joined once, by its own key."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")
    good_ids = labels.where("quality = 1 and toxic = 0").select("doc_id")
    bad_ids = labels.where("quality = 0").select("doc_id")
    items = table(spark, sf_dir, "benchmark")
    n_bad = bad_ids.agg(F.count("*")).scalar()
    n_items = items.agg(F.count("*")).scalar()
    good = dense_index(good_ids, "doc_id", 1, name="at").select(
        F.col("doc_id").alias("pair_id"), (F.col("at") % n_bad).alias("at"), (F.col("doc_id") % n_items).alias("item")
    )
    bad = dense_index(bad_ids, "doc_id", 2, name="at").withColumnRenamed("doc_id", "bad_id")
    prompts = dense_index(items, "item_id", 17, name="item").select("item", F.col("text").alias("prompt"))
    drawn = good.join(bad, "at").join(prompts, "item").select("pair_id", "bad_id", "prompt")
    chosen = docs.select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("chosen"), F.col("lang").alias("source")
    )
    rejected = docs.select(F.col("doc_id").alias("bad_id"), F.col("text").alias("rejected"))
    return drawn.join(rejected, "bad_id").join(chosen, "pair_id").select(
        "pair_id", "prompt", "chosen", "rejected", "source"
    )


FLAT_PAIRS = f"""
good as (select d.doc_id, d.text, d.lang, row_number() over (order by {H(1, 'd.doc_id')}, d.doc_id) - 1 as at
         from documents d join labels l on d.doc_id = l.doc_id where l.quality = 1 and l.toxic = 0),
bad as (select d.doc_id, d.text, row_number() over (order by {H(2, 'd.doc_id')}, d.doc_id) - 1 as at
        from documents d join labels l on d.doc_id = l.doc_id where l.quality = 0),
items as (select text, row_number() over (order by {H(17, 'item_id')}, item_id) - 1 as at from benchmark),
flat_pairs as (select g.doc_id as pair_id, m.text as prompt, g.text as chosen, b.text as rejected, g.lang as source
               from good g join bad b on b.at = g.at % (select count(*) from bad)
               join items m on m.at = g.doc_id % (select count(*) from items))"""


# Conversation pairs: a whole conversation against itself with another's last text.


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation; a conversation is a record and fits in a row."""
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("conv")
    )


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ids = turns.select("conv_id").distinct()
    n = ids.agg(F.count("*")).scalar()
    at = dense_index(ids, "conv_id", 3, name="at")
    nxt = at.select(F.col("conv_id").alias("other"), F.pmod(F.col("at") - 1, n).alias("at"))
    last = turns.groupBy(F.col("conv_id").alias("other")).agg(F.max_by("text", "turn").alias("last"))
    drawn = at.join(nxt, "at").join(last, "other").select("conv_id", "last")
    whole = conversations(spark, sf_dir).join(drawn, "conv_id")
    head = F.slice("conv", F.lit(1), F.size("conv") - 1)
    role = F.element_at("conv", -1)["role"]
    tail = F.array(F.struct(role.alias("role"), F.col("last").alias("content")))
    return whole.select(
        F.col("conv_id").alias("pair_id"), F.col("conv").alias("chosen"), F.concat(head, tail).alias("rejected")
    )


CONVERSATION_PAIRS = f"""
convs as (select conv_id, list(struct_pack(role := role, content := text) order by turn) as conv,
                 arg_max(text, turn) as last_text
          from conversations group by conv_id),
ordered as (select *, row_number() over (order by {H(3, 'conv_id')}, conv_id) - 1 as at, count(*) over () as n
            from convs),
conversation_pairs as (
  select a.conv_id as pair_id, a.conv as chosen,
         list_concat(a.conv[:-2], [struct_pack(role := a.conv[-1].role, content := b.last_text)]) as rejected
  from ordered a join ordered b on b.at = (a.at + 1) % a.n)"""


# Raw judge answers: one per order, in both orders.

# Answers a judge might give.
SAID = [
    "A is the better response",
    "B is the better response",
    "**A**",
    "a",
    "b ",
    "A great pair",
    "Based on the text",
    "",
    "API-ERROR",
    "_B is",
    "Both",
    "* b is ok",
]
JUDGES = ["GPT-4o", "Llama-3-8B", "Qwen-2-72B", "Gemma-2-9B", "DBRX-Instruct"]


def _pick(options: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), at.cast("int"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = "o_orderkey"
    return orders.select(
        F.col(key).alias("index"),
        _pick(JUDGES, portable_hash(4, key) % len(JUDGES)).alias("model"),
        _pick(["train", "val"], portable_hash(16, key) % 2).alias("split"),
        _pick(SAID, portable_hash(5, key) % len(SAID)).alias("response_orig"),
        _pick(SAID, portable_hash(6, key) % len(SAID)).alias("response_swapped"),
    )


def _sql_pick(options: list[str], at: str) -> str:
    return f"([{', '.join(sql_text(o) for o in options)}])[{at} + 1]"


RAW_ANSWERS = f"""
raw_answers as (
  select o_orderkey as index,
         {_sql_pick(JUDGES, f"{H(4, 'o_orderkey')} % {len(JUDGES)}")} as model,
         {_sql_pick(['train', 'val'], f"{H(16, 'o_orderkey')} % 2")} as split,
         {_sql_pick(SAID, f"{H(5, 'o_orderkey')} % {len(SAID)}")} as response_orig,
         {_sql_pick(SAID, f"{H(6, 'o_orderkey')} % {len(SAID)}")} as response_swapped
  from orders)"""


# Benchmark scores: a subset and two rewards per document.


def benchmark_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = [s for s, _, _ in K.BENCHMARK_SUBSETS]
    return docs.select(
        F.col("doc_id").alias("id"),
        _pick(names, F.col("doc_id") % len(names)).alias("subset"),
        ((portable_hash(7, "doc_id") % 1000) / 1000.0).alias("rc"),
        ((portable_hash(8, "doc_id") % 1000) / 1000.0).alias("rr"),
    )


BENCHMARK_REWARDS = f"""
benchmark_rewards as (
  select doc_id as id,
         {_sql_pick([s for s, _, _ in K.BENCHMARK_SUBSETS], f'doc_id % {len(K.BENCHMARK_SUBSETS)}')} as subset,
         ({H(7, 'doc_id')} % 1000) / 1000.0::double as rc, ({H(8, 'doc_id')} % 1000) / 1000.0::double as rr
  from documents)"""


# Answers to questions: eight documents answer one question, with a label and a score.

ANSWERS_PER_QUESTION = 8


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    question = F.floor(F.col("doc_id") / ANSWERS_PER_QUESTION).cast("long")
    return docs.select(
        question.alias("q_id"),
        (F.col("doc_id") % ANSWERS_PER_QUESTION).cast("int").alias("ans_idx"),
        F.concat(F.lit("Question "), question.cast("string"), F.lit(":")).alias("prompt"),
        F.col("text").alias("answer"),
        (portable_hash(9, "doc_id") % 2).cast("int").alias("label"),
        ((portable_hash(10, "doc_id") % 20) / 20.0).alias("score"),
        (portable_hash(18, "doc_id") % 5).cast("int").alias("final_answer"),
    )


ANSWERS = f"""
answers as (
  select doc_id // {ANSWERS_PER_QUESTION} as q_id, (doc_id % {ANSWERS_PER_QUESTION})::int as ans_idx,
         'Question ' || cast(doc_id // {ANSWERS_PER_QUESTION} as varchar) || ':' as prompt, text as answer,
         ({H(9, 'doc_id')} % 2)::int as label, ({H(10, 'doc_id')} % 20) / 20.0::double as score,
         ({H(18, 'doc_id')} % 5)::int as final_answer
  from documents)"""


# Step rows: one per line of a document, with a sign drawn for every completion of a step.


def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lines = F.posexplode(F.split("text", "\n", -1)).alias("step", "text")
    return docs.select(F.col("doc_id").alias("traj"), lines)


TRAJECTORY_STEPS = """
trajectory_steps as (
  select doc_id as traj, (unnest(range(len(string_split(text, chr(10))))))::int as step,
         unnest(string_split(text, chr(10))) as text
  from documents)"""


# Logits of labels A and B in both orders.


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    drawn = {
        name: (portable_hash(seed, "event_id") % 2001 - 1000) / 64.0
        for name, seed in (("a1", 11), ("b1", 12), ("a2", 13), ("b2", 14))
    }
    return events.select(
        F.col("event_id").alias("id"),
        *[c.alias(n) for n, c in drawn.items()],
        (portable_hash(19, "event_id") % 2).cast("int").alias("label"),
    )


LOGITS = f"""
logits as (
  select event_id as id, ({H(11, 'event_id')} % 2001 - 1000) / 64.0::double as a1,
         ({H(12, 'event_id')} % 2001 - 1000) / 64.0::double as b1,
         ({H(13, 'event_id')} % 2001 - 1000) / 64.0::double as a2,
         ({H(14, 'event_id')} % 2001 - 1000) / 64.0::double as b2,
         ({H(19, 'event_id')} % 2)::int as label
  from events)"""


# Embeddings with three objectives, each known for some rows.


def sparse_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    kind, label = F.col("vec_id") % 6, F.col("label")
    return rows.select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.when(kind.isin(0, 1), label / 9.0).alias("a0"),
        F.when(kind.isin(1, 2), (9 - label) / 9.0).alias("a1"),
        F.when(kind >= 3, (label % 2).cast("double")).alias("a2"),
    )


OBJECTIVES_3 = ["a0", "a1", "a2"]
SPARSE_OBJECTIVES = """
sparse_objectives as (
  select vec_id as id, embedding, case when vec_id % 6 in (0, 1) then label / 9.0::double end as a0,
         case when vec_id % 6 in (1, 2) then (9 - label) / 9.0::double end as a1,
         case when vec_id % 6 >= 3 then (label % 2)::double end as a2
  from embeddings)"""


# Pair embeddings: neighbours 2k and 2k+1; the prompt vector is the chosen one, reversed.


def pair_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    even = F.col("vec_id") % 2 == 0

    def side(when: Column, name: str) -> Column:
        return F.any_value(F.when(when, F.col("embedding")), ignoreNulls=True).alias(name)

    pairs = rows.groupBy(F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id")).agg(
        side(even, "chosen_emb"), side(~even, "rejected_emb")
    )
    whole = pairs.dropna()
    return whole.withColumns(
        {"chosen_prompt_emb": F.reverse("chosen_emb"), "rejected_prompt_emb": F.reverse("chosen_emb")}
    )


PAIR_EMBEDDINGS = """
pair_embeddings as (
  select c.vec_id // 2 as pair_id, c.embedding as chosen_emb, r.embedding as rejected_emb,
         list_reverse(c.embedding) as chosen_prompt_emb, list_reverse(c.embedding) as rejected_prompt_emb
  from embeddings c join embeddings r on r.vec_id = c.vec_id + 1 where c.vec_id % 2 = 0)"""

DIM = 64


def drawn_matrix(seed: int, rows: int, cols: int = DIM) -> np.ndarray:
    """A fixed matrix of numbers in [-1, 1] with three decimals."""

    def cell(i: int) -> float:
        return (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % 2001 - 1000) / 1000

    return np.array([[cell(r * cols + c) for c in range(cols)] for r in range(rows)])


def sql_matrix(name: str, seed: int, rows: int, cols: int = DIM) -> str:
    """CTE `name` (j, w) with the rows of `drawn_matrix`."""
    at = f"(j * {cols} + i)"
    return f"""
{name} as (select j, list(({H(seed, at)} % 2001 - 1000) / 1000.0::double order by i) as w
           from range({rows}) a(j), range({cols}) b(i) group by j)"""


# Token ids: length of every word, modulo 5.

TOKEN_PATTERN = [2, 3]


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = F.split("text", "[ \n\t]+")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.transform(words, lambda w: (F.length(w) % 5).cast("int")).alias("ids"),
        X.token_length("text").alias("length"),
    )


TOKEN_IDS = r"""
token_ids as (
  select doc_id as id, list_transform(regexp_split_to_array(text, '[ \n\t]+'), lambda w: (length(w) % 5)::int) as ids,
         len(regexp_extract_all(text, '\S+'))::int as length
  from documents)"""
