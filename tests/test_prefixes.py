import hashlib

import pytest
from pyspark.sql import functions as F

from checks import step_queries
from prefops.operators import prefixes, steps

ANSWERS = [
    (1, 0, "Q", "aки\nbки\nc"),
    (1, 1, "Q", "aки\nbки\nd"),
    (1, 2, "Q", "aки\nb"),
    (1, 3, "Q", "aки\nbки\nc"),
    (2, 0, "Q", "aки\n"),
    (2, 1, "P", "aки\nbки\nc"),
    (3, 0, "Q", ""),
    (3, 1, "Q", "bки\na"),
    (4, 0, None, "aки\nb"),
    (4, 1, "Q", None),
]
SCHEMA = "q_id int, ans_idx int, prompt string, answer string"


def plain(rows):
    """(keys, step) to the tuple of turns so far."""
    out = {}
    for q, i, prompt, answer in rows:
        if prompt is None or answer is None:
            continue
        turns = [t.strip() for t in answer.split("ки\n")]
        turns[0] = f"{prompt} {turns[0]}"
        for k in range(len(turns)):
            out[q, i, k] = tuple(turns[: k + 1])
    return out


def named(turns):
    last = ""
    for t in turns:
        last = hashlib.sha256(f"{last}\n{t}".encode()).hexdigest()
    return last


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame(ANSWERS, SCHEMA).withColumn("text", F.lit("clash"))


def test_nodes_and_members(answers):
    want = plain(ANSWERS)
    assert {(r.q_id, r.ans_idx, r.step): r.id for r in prefixes.prefix_members(answers).collect()} == {k: named(t) for k, t in want.items()}
    nodes = prefixes.prefix_nodes(answers).collect()
    distinct = set(want.values())
    assert sorted((r.id, r.parent or "", r.step, r.text) for r in nodes) == sorted((named(t), named(t[:-1]), len(t) - 1, t[-1]) for t in distinct)
    # The beginnings written out are those of `prefix_dialogues`.
    whole = steps.prefix_dialogues(answers.where("prompt is not null and answer is not null"))
    assert {(r.q_id, r.ans_idx, r.step): tuple(m["content"] for m in r.dialogue if m["role"] == "user") for r in whole.collect()} == want


def test_text_grows_with_the_different_turns(spark):
    """A hundred answers of fifty steps that part at the last one."""
    df = spark.createDataFrame([(0, i, "Q", "ки\n".join([*map(str, range(49)), f"end {i}"])) for i in range(100)], SCHEMA)
    assert prefixes.prefix_nodes(df).count() == 49 + 100
    assert prefixes.whole_dialogues(df).count() == 100


def test_whole_dialogues_hold_every_node_once_or_more(answers):
    want = plain(ANSWERS)
    ends = {t for t in want.values() if not any(o[: len(t)] == t and len(o) > len(t) for o in want.values())}
    rows = prefixes.whole_dialogues(answers).collect()
    assert sorted(tuple(m["content"] for m in r.dialogue if m["role"] == "user") for r in rows) == sorted(ends)
    assert {i for r in rows for i in r.ids} == {named(t) for t in want.values()}


def test_scores_come_back_to_every_step(answers):
    want = plain(ANSWERS)
    members = prefixes.prefix_members(answers)
    score = F.size("dialogue") * 0
    lists = prefixes.whole_dialogues(answers).select("ids", F.transform("ids", lambda x: F.length(x) * 0 + F.hash(x) + score).alias("s"))
    got = {(r.q_id, r.ans_idx, r.step): r.s for r in prefixes.scores_of_steps(members, lists).collect()}
    by_id = {r.id: r.s for r in prefixes.prefix_nodes(answers).select("id", F.hash("id").alias("s")).collect()}
    assert got == {k: by_id[named(t)] for k, t in want.items()}
    one = prefixes.scores_of_steps(members, prefixes.prefix_nodes(answers).select("id", F.hash("id").alias("s")))
    assert {(r.q_id, r.ans_idx, r.step): r.s for r in one.collect()} == got


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefixes.prefix_nodes(df).count() == prefixes.whole_dialogues(df).count() == prefixes.prefix_members(df).count() == 0


def test_running_takes_one_step_an_element(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 4, 5]), (2, []), (3, None)], "k int, v array<int>")
    sums = prefixes.running(F.col("v"), "int", lambda n, x: F.coalesce(n, F.lit(0)) + x)
    assert {r.k: r.s for r in df.select("k", sums.alias("s")).collect()} == {1: [3, 7, 12], 2: [], 3: None}
    # No step reads the elements before it again.
    docs = [(i, "\n".join(f"line {i} {k}" for k in range(i)), "en", "web", 9) for i in range(1, 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    scored = step_queries.p1_prefix(spark, str(tmp_path))
    assert "lambda" in (plan := scored._jdf.queryExecution().optimizedPlan().toString()) and "aggregate(slice(" not in plan
    assert scored.count() == sum(2 * i + 1 for i in range(1, 20))
