"""Step-wise answers and the choice among many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs as I
from checks.base import query, r6, sql_r6, sql_text
from checks.base import sql_hash as H
from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.functions.rand import portable_hash
from prefops.operators import benchmark, prefixes, ranking, steps
from prefops.plans import best_of_n
from prefops.sources import io

NL = "chr(10)"
WS = sql_text(K.PY_SPACE)
TAG = K.STEP_TAG


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose lines are steps, each closed by the step tag."""
    text = F.concat(F.replace("answer", F.lit("\n"), F.lit(f"{TAG}\n")), F.lit(TAG))
    return I.answers(spark, d).withColumn("answer", text)


TAGGED = f"""{I.ANSWERS},
tagged as (select * replace (replace(answer, {NL}, '{TAG}' || {NL}) || '{TAG}' as answer) from answers),
tagged_steps as (select q_id, ans_idx, prompt, unnest(range(len(s)))::int as step, trim(unnest(s), {WS}) as text
                 from (select *, string_split(answer, 'ки' || {NL}) as s from tagged))"""


@query("f6_first_n_answers", f"with {I.ANSWERS} select q_id, ans_idx, label from answers where ans_idx < 3")
def f6(spark, d):
    return steps.first_n_answers(I.answers(spark, d), 3).select("q_id", "ans_idx", "label")


@query(
    "t9_split_steps",
    f"""with {TAGGED} select q_id, ans_idx, 'Mistral' as model_type, step, text from tagged_steps
    union all select q_id, ans_idx, 'Deepseek', unnest(range(len(s)))::int, trim(unnest(s), {WS})
    from (select *, string_split(replace(answer, {NL}, {NL} || {NL}), {NL} || {NL}) as s from answers)""",
)
def t9(spark, d):
    def rows(df: DataFrame, model_type: str) -> DataFrame:
        s = X.split_steps("answer", model_type)
        return df.select("q_id", "ans_idx", F.lit(model_type).alias("model_type"), F.posexplode(s).alias("step", "text"))

    spaced = I.answers(spark, d).withColumn("answer", F.replace("answer", F.lit("\n"), F.lit("\n\n")))
    return rows(tagged(spark, d), "Mistral").unionByName(rows(spaced, "Deepseek"))


@query(
    "t10_prm_step_rows",
    f"""with {TAGGED} select q_id, ans_idx, step, case when step = 0 then prompt || ' ' || text else text end as text
    from tagged_steps""",
)
def t10(spark, d):
    return steps.step_rows(tagged(spark, d))


@query(
    "t10_prm_dialogue",
    f"""with {TAGGED}, turns as (select *, case when step = 0 then prompt || ' ' || text else text end as t from tagged_steps)
    select q_id, ans_idx, 2 * count(*)::int as n_turns,
           md5(array_to_string(list('user:' || t || '|assistant:+' order by step), '|')) as dialogue
    from turns group by q_id, ans_idx""",
)
def t10_dialogue(spark, d):
    turns = X.prm_dialogue("prompt", X.split_steps("answer"))
    said = F.transform("turns", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return (
        tagged(spark, d)
        .select("q_id", "ans_idx", turns.alias("turns"))
        .select("q_id", "ans_idx", F.size("turns").alias("n_turns"), F.md5(F.array_join(said, "|")).alias("dialogue"))
    )


@query(
    "t10_prefix_dialogues",
    f"""with lines as (
      select conv_id as q_id, turn as ans_idx, unnest(range(len(s)))::int as step, unnest(s) as line
      from (select *, list_transform(string_split(text, {NL}), lambda x: trim(x, {WS})) as s
            from conversations)),
    turns as (select * replace (case when step = 0 then 'Q: ' || line else line end as line) from lines)
    select a.q_id, a.ans_idx, a.step, 2 * count(*)::int as n_turns, md5(array_to_string(list(b.line || '+' order by b.step), '')) as said
    from turns a join turns b on a.q_id = b.q_id and a.ans_idx = b.ans_idx and b.step <= a.step
    group by a.q_id, a.ans_idx, a.step""",
)
def t10_prefixes(spark, d):
    rows = I.table(spark, d, "conversations").select(
        F.col("conv_id").alias("q_id"),
        F.col("turn").alias("ans_idx"),
        F.lit("Q:").alias("prompt"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("answer"),
    )
    said = F.array_join(F.transform("dialogue", lambda m: m["content"]), "")
    return steps.prefix_dialogues(rows, "Deepseek").select(
        "q_id", "ans_idx", "step", F.size("dialogue").alias("n_turns"), F.md5(said).alias("said")
    )


def branching(spark: SparkSession, d: str) -> DataFrame:
    """The tagged answers, each a second time with a further step: two answers with a common beginning."""
    once = tagged(spark, d).select("q_id", "ans_idx", "prompt", "answer")
    longer = once.withColumns({"ans_idx": F.col("ans_idx") + I.ANSWERS_PER_QUESTION, "answer": F.concat("answer", F.lit(f"\nSo it is.{TAG}"))})
    return once.unionByName(longer)


BRANCHING = f"""{TAGGED},
branching as (select q_id, ans_idx, prompt, answer from tagged
    union all select q_id, ans_idx + {I.ANSWERS_PER_QUESTION}, prompt, answer || {NL} || 'So it is.{TAG}' from tagged),
turns as (select q_id, ans_idx, step, case when step = 0 then prompt || ' ' || text else text end as text
    from (select q_id, ans_idx, prompt, unnest(range(len(s)))::int as step, trim(unnest(s), {WS}) as text
          from (select *, string_split(answer, 'ки' || {NL}) as s from branching)))"""


@query(
    "t10_prefix_nodes",
    f"""with recursive {BRANCHING},
    chain(q_id, ans_idx, step, id, parent, text) as (
      select q_id, ans_idx, step, sha256(chr(10) || text), null::varchar, text from turns where step = 0
      union all select t.q_id, t.ans_idx, t.step, sha256(c.id || chr(10) || t.text), c.id, t.text
      from chain c join turns t on t.q_id = c.q_id and t.ans_idx = c.ans_idx and t.step = c.step + 1)
    select distinct id, parent, step, md5(text) as text from chain""",
)
def t10_nodes(spark, d):
    return prefixes.prefix_nodes(branching(spark, d)).withColumn("text", F.md5("text"))


@query(
    "p1_scores_by_prefix",
    f"""with {BRANCHING}, read as (select *, sum(length(text)) over (partition by q_id, ans_idx order by step) as n from turns)
    select q_id, ans_idx, step, {sql_r6("1 / (1 + exp((n % 7) / 4.0::double - (n % 11) / 4.0::double))")} as score from read""",
)
def p1_prefix(spark, d):
    """A model that reads a dialogue once and scores every turn on what it has read so far: here by the number of characters."""
    answers = branching(spark, d)
    texts = F.transform(F.filter("dialogue", lambda m: m["role"] == "user"), lambda m: m["content"])
    read = prefixes.running(texts, "int", lambda n, t: F.coalesce(n, F.lit(0)) + F.char_length(t))
    scored = prefixes.whole_dialogues(answers).select("ids", read.alias("n"))
    rows = prefixes.scores_of_steps(prefixes.prefix_members(answers), scored)
    score = S.softmax_pair((F.col("n") % 11) / 4.0, (F.col("n") % 7) / 4.0)
    return rows.select("q_id", "ans_idx", "step", r6(score).alias("score"))


@query(
    "t11_orm_dialogue",
    f"""with {TAGGED} select q_id, ans_idx, prompt || ' ' || replace(answer, '{TAG}', '') as content, '+' as reply from tagged""",
)
def t11(spark, d):
    turns = X.orm_dialogue("prompt", "answer")
    return tagged(spark, d).select(
        "q_id", "ans_idx", F.get(turns, F.lit(0))["content"].alias("content"), F.get(turns, F.lit(1))["content"].alias("reply")
    )


def signed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as numbered steps with a sign."""
    lines = F.transform(
        F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), x)
    )
    sign = F.when(portable_hash(29, "doc_id") % 2 == 0, F.lit("+")).otherwise(F.lit("-"))
    return I.documents(spark, d).select(
        F.col("doc_id").alias("id"),
        X.user_assistant(F.concat(F.lit("Read this. "), F.array_join(lines, "\n")), sign).alias("conversations"),
    )


SIGNED = f"""signed as (
  select doc_id as id, 'Read this. ' || array_to_string(list_transform(string_split(text, {NL}),
             lambda x, i: 'Step ' || i || ': ' || x), {NL}) as content,
         ({H(29, 'doc_id')} % 2 = 0)::int as label from documents)"""


@query(
    "t12_orm_training_row",
    f"""with {SIGNED} select id, string_split(content, 'Step 1')[1] as question,
        'Step 1' || string_split(content, 'Step 1')[2] as answer, label from signed""",
)
def t12(spark, d):
    return steps.orm_training_row(signed(spark, d))


@query(
    "t12_orm_training_row_exact",
    f"""with {SIGNED} select id, string_split(content, 'Step 1')[1] as question,
        substr(content, instr(content, 'Step 1')) as answer, label from signed""",
)
def t12_exact(spark, d):
    return steps.orm_training_row(signed(spark, d), exact=True)


@query(
    "t13_last_subsequence",
    f"""with {I.TOKEN_IDS} select id, (list_max(list_filter(list_transform(ids,
        lambda x, i: case when x = 2 and ids[i + 1] = 3 then i - 1 end), lambda v: v is not null)))::int as position from token_ids""",
)
def t13(spark, d):
    return I.token_ids(spark, d).select("id", X.last_subsequence("ids", I.TOKEN_PATTERN).alias("position"))


@query(
    "t15_parse_sign",
    f"with {SIGNED} select id, label from signed",
)
def t15(spark, d):
    return signed(spark, d).select("id", X.parse_sign(F.col("conversations")[1]["content"]).alias("label"))


# Scores of steps and answers


def step_scores(spark: SparkSession, d: str) -> DataFrame:
    """A score for every line of an answer; a mean of 997ths is not half-way between two decimals."""
    n = I.ANSWERS_PER_QUESTION
    rows = I.trajectory_steps(spark, d)
    return rows.select(
        F.floor(F.col("traj") / n).cast("long").alias("q_id"),
        (F.col("traj") % n).cast("int").alias("ans_idx"),
        "step",
        ((portable_hash(30, "traj", "step") % 997) / 997.0).alias("score"),
    )


STEP_SCORES = f"""{I.TRAJECTORY_STEPS},
step_scores as (select traj // {I.ANSWERS_PER_QUESTION} as q_id, (traj % {I.ANSWERS_PER_QUESTION})::int as ans_idx, step,
                       ({H(30, 'traj', 'step')} % 997) / 997.0::double as score from trajectory_steps)"""


@query(
    "p12_answer_score",
    f"with {STEP_SCORES} select q_id, ans_idx, {sql_r6('avg(score)')} as score from step_scores group by q_id, ans_idx",
)
def p12(spark, d):
    return steps.answer_scores(step_scores(spark, d)).withColumn("score", r6("score"))


@query(
    "p12_answer_score_array",
    f"""with {I.TOKEN_IDS} select id, {sql_r6('list_avg(list_transform(ids, lambda x: x / 4.0::double))')} as score from token_ids""",
)
def p12_array(spark, d):
    scores = F.transform("ids", lambda x: x / 4.0)
    return I.token_ids(spark, d).select("id", r6(S.answer_score(scores)).alias("score"))


def sql_best(n: int) -> str:
    return f"""select q_id, ans_idx, score, label = 1 as correct from answers where ans_idx < {n}
        qualify row_number() over (partition by q_id order by score desc, ans_idx) = 1"""


@query("p13_best_of_n", f"with {I.ANSWERS} {sql_best(8)}")
def p13(spark, d):
    return ranking.best_of_n(I.answers(spark, d))


@query("p13_best_of_4", f"with {I.ANSWERS} {sql_best(4)}")
def p13_4(spark, d):
    return ranking.best_of_n(I.answers(spark, d), 4)


@query(
    "p14_tournament",
    f"""with {I.ANSWERS},
    r0 as (select q_id, ans_idx as place, ans_idx from answers),
    {', '.join(f'''r{n + 1} as (
      select coalesce(a.q_id, b.q_id) as q_id, coalesce(a.place // 2, b.place // 2) as place,
             case when b.ans_idx is null then a.ans_idx when a.ans_idx is null then b.ans_idx
                  when ({H(31, "a.q_id", "a.ans_idx", "b.ans_idx")} % 1000) / 999.0::double >= 0.5 then a.ans_idx else b.ans_idx end as ans_idx
      from (select * from r{n} where place % 2 = 0) a full join (select * from r{n} where place % 2 = 1) b
        on a.q_id = b.q_id and a.place // 2 = b.place // 2)''' for n in range(3))}
    select r.q_id, r.ans_idx, a.label from r3 r join answers a on a.q_id = r.q_id and a.ans_idx = r.ans_idx""",
)
def p14(spark, d):
    def wins(a, b):
        return (portable_hash(31, a["q_id"], a["ans_idx"], b["ans_idx"]) % 1000) / 999.0

    return ranking.tournament(I.answers(spark, d).select("q_id", "ans_idx", "label"), wins, columns=[])


@query(
    "p14_tournament_batch",
    f"""with {I.ANSWERS}, best as (select q_id, max(score) as score from answers group by q_id)
    select a.q_id, min(a.ans_idx) as ans_idx, b.score from answers a join best b on a.q_id = b.q_id and a.score = b.score group by all""",
)
def p14_batch(spark, d):
    """Matches scored a round at a time; the better score wins, so the first best answer wins the tournament."""
    rows = I.answers(spark, d).select("q_id", "ans_idx", "score")

    def met(matches: DataFrame) -> DataFrame:
        return matches.withColumn("prob_a", F.when(F.col("a.score") >= F.col("b.score"), 1.0).otherwise(0.0))

    return ranking.tournament(rows, met, batch=True)


@query("p15_pass_at_1", f"with {I.ANSWERS} select q_id, {sql_r6('avg(label)')} as pass_at_1 from answers group by q_id")
def p15(spark, d):
    return ranking.pass_at_1(I.answers(spark, d)).withColumn("pass_at_1", r6("pass_at_1"))


@query(
    "p15_majority_vote",
    f"""with {I.ANSWERS}, v as (select q_id, final_answer, count(*) as votes, min(ans_idx) as first, arg_min(label, ans_idx) as l
                               from answers group by all)
    select q_id, final_answer, votes, l = 1 as correct from v
    qualify row_number() over (partition by q_id order by votes desc, first) = 1""",
)
def p15_vote(spark, d):
    return ranking.majority_vote(I.answers(spark, d))


@query(
    "a4_mean_accuracy",
    f"with {I.ANSWERS}, best as ({sql_best(8)}) select {sql_r6('avg(correct::int)')} as accuracy, count(*) as n from best",
)
def a4(spark, d):
    scored = I.answers(spark, d)
    return best_of_n.accuracy(scored).withColumn("accuracy", r6("accuracy"))


@query(
    "a14_hard_step_labels",
    """select l_orderkey as traj, l_linenumber as step, case when max((l_quantity > 25)::int) = 1 then '+' else '-' end as sign
    from lineitem group by l_orderkey, l_linenumber""",
)
def a14(spark, d):
    done = I.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("traj"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") > 25).alias("correct")
    )
    return steps.hard_step_labels(done)


@query(
    "a15_orm_from_prm",
    f"""with {I.TRAJECTORY_STEPS}, s as (
      select *, case when {H(32, 'traj', 'step')} % 2 = 0 then '+' else '-' end as sign from trajectory_steps)
    select traj, array_to_string(list(text order by step), {NL}) as text, arg_max(sign, step) as sign from s group by traj""",
)
def a15(spark, d):
    sign = F.when(portable_hash(32, "traj", "step") % 2 == 0, F.lit("+")).otherwise(F.lit("-"))
    return steps.orm_from_prm(I.trajectory_steps(spark, d).withColumn("sign", sign))


STEP_LOGITS = f"""{TAGGED}, scored as (
  select q_id, ans_idx, step, 1 / (1 + exp((length(text) % 7) / 4.0::double - (length(text) % 11) / 4.0::double)) as score
  from (select q_id, ans_idx, step, case when step = 0 then prompt || ' ' || text else text end as text from tagged_steps)),
means as (select q_id, ans_idx, avg(score) as score from scored group by q_id, ans_idx)"""


def _step_logits(df: DataFrame) -> DataFrame:
    n = F.length("text")
    return df.withColumns({"plus": (n % 11) / 4.0, "minus": (n % 7) / 4.0})


@query(
    "best_of_n_by_steps",
    f"""with {STEP_LOGITS} select a.q_id, a.ans_idx, a.label, {sql_r6('m.score')} as score
    from answers a join means m on a.q_id = m.q_id and a.ans_idx = m.ans_idx""",
)
def bon_steps(spark, d):
    return best_of_n.step_scored(tagged(spark, d), _step_logits).withColumn("score", r6("score"))


@query(
    "best_of_n_by_outcome",
    f"""with {TAGGED}, t as (select *, length(prompt || ' ' || replace(answer, '{TAG}', '')) as n from tagged where ans_idx < 6)
    select q_id, ans_idx, label, {sql_r6('1 / (1 + exp((n % 7) / 4.0::double - (n % 11) / 4.0::double))')} as score from t""",
)
def bon_outcome(spark, d):
    return best_of_n.outcome_scored(tagged(spark, d), _step_logits, 6).withColumn("score", r6("score"))


@query(
    "s5_question_records",
    f"""with {STEP_LOGITS}, one as (
      select a.q_id, a.ans_idx, a.answer, a.label, list(round(s.score, 9) order by s.step) as scores
      from tagged a join scored s on s.q_id = a.q_id and s.ans_idx = a.ans_idx group by all)
    select q_id, count(*) as n_answers, md5(string_agg(answer, '|' order by ans_idx)) as answers,
           string_agg(label::varchar, ',' order by ans_idx) as label, string_agg(len(scores)::varchar, ',' order by ans_idx) as n_steps,
           {sql_r6('sum(list_sum(scores))')} as total
    from one group by q_id""",
)
def s5_questions(spark, d):
    """One object per question, written and read again."""
    path = io.scratch_path(spark, "questions")
    answers = tagged(spark, d)
    scored = _step_logits(steps.step_rows(answers)).withColumn("score", F.round(S.softmax_pair("plus", "minus"), 9))
    io.write_jsonl(best_of_n.question_records(answers, scored), path)
    back = io.read_split(spark, path, format="json", schema=best_of_n.QUESTION_SCHEMA)
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    total = F.aggregate(F.flatten("step_scores"), F.lit(0.0), lambda a, x: a + x)
    return back.select(
        "q_id", F.size("answers").cast("long").alias("n_answers"), F.md5(F.array_join("answers", "|")).alias("answers"),
        joined(F.col("label")).alias("label"), joined(F.transform("step_scores", F.size)).alias("n_steps"), r6(total).alias("total"),
    )


@query(
    "d12_explode_answers",
    f"with {TAGGED} select q_id, ans_idx, answer, label from tagged where ans_idx < 5",
)
def d12(spark, d):
    """From answer rows to arrays and back, with the first five of each array."""
    scored = steps.step_rows(tagged(spark, d)).withColumn("score", F.lit(0.0))
    arrays = best_of_n.question_records(tagged(spark, d), scored)
    return steps.explode_answers(steps.first_n_answers(arrays.drop("step_scores"), 5)).select("q_id", "ans_idx", "answer", "label")


@query(
    "best_of_n_accuracy",
    f"""with {STEP_LOGITS}, best as (
      select a.q_id, arg_max(a.label, {{'s': round(m.score, 6), 'i': -a.ans_idx}}) as l
      from answers a join means m on a.q_id = m.q_id and a.ans_idx = m.ans_idx group by a.q_id)
    select 'steps' as run, {sql_r6('avg((l = 1)::int)')} as accuracy, count(*) as n from best""",
)
def bon_accuracy(spark, d):
    path = io.scratch_path(spark, "accuracy")
    best_of_n.write_accuracy(bon_steps(spark, d), path, "steps")
    return io.read_split(spark, path).withColumn("accuracy", r6("accuracy"))


RECORD = T.StructType(
    [
        T.StructField("q_id", T.LongType()),
        T.StructField("ans_idx", T.IntegerType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("step_scores", T.ArrayType(T.DoubleType())),
    ]
)


@query(
    "s5_write_jsonl",
    f"""with {I.ANSWERS} select q_id, ans_idx, prompt, answer, label, len(string_split(answer, {NL}))::int as n_steps,
        {sql_r6(f"list_avg(list_transform(string_split(answer, {NL}), lambda x: (length(x) % 10) / 10.0::double))")} as score
    from answers""",
)
def s5(spark, d):
    path = io.scratch_path(spark, "scored")
    scores = F.transform(F.split("answer", "\n", -1), lambda x: (F.length(x) % 10) / 10.0)
    rows = I.answers(spark, d).withColumn("step_scores", scores).select(*RECORD.fieldNames())
    io.write_jsonl(rows, path)
    back = io.read_split(spark, path, format="json", schema=RECORD)
    return back.select(
        "q_id", "ans_idx", "prompt", "answer", "label", F.size("step_scores").alias("n_steps"),
        r6(S.answer_score("step_scores")).alias("score"),
    )
