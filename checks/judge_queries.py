"""Multi-turn texts, judge prompts, verdicts, resuming and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query, sql_r6, sql_text
from checks.base import sql_hash as H
from checks.base import r6
from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.functions.rand import portable_hash
from prefops.operators import judge
from prefops.plans import reports
from prefops.sources import io
from prefops.streaming import labelling

NL = "chr(10)"
WS = sql_text(K.PY_SPACE)
MARK = K.MULTITURN_MARK

# Multi-turn texts made of conversations: first text, then marked turns.


def marked_texts(spark: SparkSession, d: str) -> DataFrame:
    pairs = I.conversation_pairs(spark, d)
    roles = F.create_map(*[F.lit(x) for x in ("user", "User", "assistant", "Assistant", "system", "System")])
    turns = F.transform(
        "chosen",
        lambda m, i: F.when(i == 0, F.concat(m["content"], F.lit("\n\n"))).otherwise(
            F.concat(F.lit(MARK), F.try_element_at(roles, m["role"]), F.lit("\n"), m["content"], F.lit("\n"))
        ),
    )
    return pairs.select(
        "pair_id",
        F.array_join(turns, "").alias("prompt"),
        X.last_content("chosen").alias("response_1"),
        X.last_content("rejected").alias("response_2"),
    )


MARKED_TEXTS = f"""{I.CONVERSATION_PAIRS},
marked_texts as (
  select pair_id, array_to_string(list_transform(chosen, lambda m, i: case when i = 1 then m.content || {NL} || {NL}
      else '{MARK}' || upper(m.role[1]) || m.role[2:] || {NL} || m.content || {NL} end), '') as prompt,
      chosen[-1].content as response_1, rejected[-1].content as response_2
  from conversation_pairs),
parsed as (
  select *, list_transform(string_split(prompt, '{MARK}'), lambda p, i: struct_pack(
      role := case when i > 1 and split_part(p, {NL}, 1) = 'Assistant' then 'assistant' else 'user' end,
      content := rtrim(case when i = 1 then p else substr(p, instr(p, {NL}) + 1) end, {NL}))) as conv
  from marked_texts)"""


@query(
    "t5_parse_multiturn",
    f"""with {MARKED_TEXTS}
    select pair_id, unnest(range(len(conv)))::int as turn, unnest(conv).role as role, unnest(conv).content as content
    from parsed""",
)
def t5(spark, d):
    conv = X.parse_multiturn("prompt")
    return (
        marked_texts(spark, d)
        .select("pair_id", F.posexplode(conv).alias("turn", "m"))
        .select("pair_id", "turn", "m.role", "m.content")
    )


def sql_judge_prompt(first: str, second: str) -> str:
    head, rest = K.JUDGE_TEMPLATE.split("{conversation}")
    between, rest = rest.split("{response_1}")
    middle = rest.split("{response_2}")[0]
    return f"""({sql_text(head)} || trim(array_to_string(list_transform(conv, lambda m:
        case when m.role = 'user' then {sql_text(K.JUDGE_USER)} else {sql_text(K.JUDGE_ASSISTANT)} end || m.content), ''), {WS})
        || {sql_text(between)} || {first} || {sql_text(middle)} || {second})"""


@query(
    "t6_judge_prompt",
    f"""with {MARKED_TEXTS} select pair_id, {sql_judge_prompt('response_1', 'response_2')} as prompt_orig,
        {sql_judge_prompt('response_2', 'response_1')} as prompt_swapped from parsed""",
)
def t6(spark, d):
    return judge.judge_prompts(marked_texts(spark, d), "pair_id")


def sql_verdict(t: str) -> str:
    said = f"ltrim(lower(trim({t}, {WS})), '*_ ')"
    return f"""(case when {t} = 'API-ERROR' then 'API-ERROR'
        when {said} = 'a' or starts_with({said}, 'a ') then 'A'
        when {said} = 'b' or starts_with({said}, 'b ') then 'B' else 'FORMAT-ERROR' end)"""


@query(
    "t7_parse_verdict",
    f"""with {I.RAW_ANSWERS} select index, {sql_verdict('response_orig')} as verdict_orig,
        {sql_verdict("chr(9) || response_swapped || ' ' || chr(10)")} as verdict_swapped from raw_answers""",
)
def t7(spark, d):
    padded = F.concat(F.lit("\t"), "response_swapped", F.lit(" \n"))
    return I.raw_answers(spark, d).select(
        "index", X.parse_verdict("response_orig").alias("verdict_orig"), X.parse_verdict(padded).alias("verdict_swapped")
    )


PREFIXES = {"user": "<|user|>", "assistant": "<|model|>", "system": "<|sys|>"}
BOS, EOT = "<s>", "</s>\n"


@query(
    "t8_render_chat",
    f"""with {I.CONVERSATION_PAIRS} select pair_id, replace('{BOS}' || array_to_string(list_transform(chosen, lambda m:
        case m.role when 'user' then '<|user|>' when 'assistant' then '<|model|>' else '<|sys|>' end || m.content || {sql_text(EOT)}),
        ''), '{BOS}', '') as text from conversation_pairs""",
)
def t8(spark, d):
    return I.conversation_pairs(spark, d).select("pair_id", X.render_chat("chosen", PREFIXES, EOT, BOS).alias("text"))


@query(
    "p4_consistent_preference",
    f"""with {I.RAW_ANSWERS}, v as (select index, {sql_verdict('response_orig')} as o, {sql_verdict('response_swapped')} as s from raw_answers)
    select index, case when o = 'B' and s = 'A' then 1 when o = 'A' and s = 'B' then -1 else 0 end as preference from v""",
)
def p4(spark, d):
    verdicts = X.parse_verdict("response_orig"), X.parse_verdict("response_swapped")
    return I.raw_answers(spark, d).select("index", S.consistent_preference(*verdicts).alias("preference"))


# Registry of judges


def _sql_models() -> str:
    def lit(v):
        return "null" if v is None else sql_text(v) if isinstance(v, str) else str(v)

    rows = ", ".join("(" + ", ".join(lit(v) for v in m) + ")" for m in K.JUDGE_MODELS)
    return f"models as (select * from (values {rows}) m(model, tokens, size, vendor, error))"


@query(
    "f7_usable_models",
    f"""with {I.RAW_ANSWERS}, {_sql_models()}
    select r.index, r.model from raw_answers r where r.model in
      (select model from models where error is null and coalesce(vendor, 'together') = 'together' and size < 70)""",
)
def f7(spark, d):
    """Answers of the usable judges below 70B."""
    usable = judge.usable_models(judge.judge_models(spark), max_size=70.0)
    return I.raw_answers(spark, d).select("index", "model").join(usable.select("model"), "model", "left_semi")


# Resuming and merging

SQL_JUDGED = f"""judged as (
  select split, index, model, o as preference_orig_order, s as preference_swapped_order,
         case when o = 'B' and s = 'A' then 1 when o = 'A' and s = 'B' then -1 else 0 end as preference,
         case when failed then 'API-ERROR' else trim(response_orig, {WS}) end as response_orig,
         case when failed then 'API-ERROR' else trim(response_swapped, {WS}) end as response_swapped
  from (select *, {sql_verdict('response_orig')} as o, {sql_verdict('response_swapped')} as s,
               response_orig = 'API-ERROR' or response_swapped = 'API-ERROR' as failed from raw_answers))"""


@query("t7_judge_rows", f"with {I.RAW_ANSWERS}, {SQL_JUDGED} select * from judged")
def t7_rows(spark, d):
    return judge.judge_rows(I.raw_answers(spark, d))


@query("streaming_label_batches", f"with {I.RAW_ANSWERS}, {SQL_JUDGED} select * from judged")
def label_batches(spark, d):
    """Two batches of a labelling run, the second with the answers of the first again, which are left out."""
    path = io.scratch_path(spark, "labelled")
    rows = I.raw_answers(spark, d)
    labelling.label_batch(rows.where("index % 3 = 0"), 0, path)
    labelling.label_batch(rows.withColumn("response_orig", F.when(F.col("index") % 3 == 0, F.lit("B")).otherwise(F.col("response_orig"))), 1, path)
    return labelling.read_results(spark, path)


@query("streaming_label_stream", f"with {I.RAW_ANSWERS}, {SQL_JUDGED} select * from judged")
def label_stream(spark, d):
    """A stream of four batches; each file but the first repeats keys of the one before with another answer."""
    answers, results, state = (io.scratch_path(spark, name) for name in ("answers", "labelled", "labelling-state"))
    rows = I.raw_answers(spark, d)
    for n in range(4):
        again = rows.where(F.col("index") % 4 == n - 1).withColumn("response_orig", F.lit("B"))
        part = rows.where(F.col("index") % 4 == n).unionByName(again)
        part.select(*labelling.ANSWERS.fieldNames()).write.parquet(f"{answers}/{n}")
        labelling.label_stream(spark, f"{answers}/*", results, state).awaitTermination()
    return labelling.read_results(spark, results)


@query(
    "c9_pending",
    f"with {I.RAW_ANSWERS} select index, model, split from raw_answers where {H(26, 'index')} % 3 <> 0",
)
def c9(spark, d):
    rows = I.raw_answers(spark, d)
    done = rows.where(portable_hash(26, "index") % 3 == 0)
    return judge.pending(rows, done).select("index", "model", "split")


def _swapped(df: DataFrame) -> DataFrame:
    return df.withColumns({"response_orig": F.col("response_swapped"), "response_swapped": F.col("response_orig")})


@query(
    "c10_merge_results",
    f"""with {I.RAW_ANSWERS}, {SQL_JUDGED},
    flip as (select split, index, model, preference_swapped_order as preference_orig_order,
             preference_orig_order as preference_swapped_order, -preference as preference, response_swapped as response_orig,
             response_orig as response_swapped from judged where {H(27, 'index')} % 2 = 0)
    select * from flip union all
    select * from judged where {H(26, 'index')} % 3 = 0 and {H(27, 'index')} % 2 <> 0""",
)
def c10(spark, d):
    rows = I.raw_answers(spark, d)
    old = judge.judge_rows(rows.where(portable_hash(26, "index") % 3 == 0))
    return reports.judge_run(_swapped(rows.where(portable_hash(27, "index") % 2 == 0)), old)


@query(
    "a16_judge_summary",
    f"""with {I.RAW_ANSWERS}, {SQL_JUDGED}, j as (select *, preference_orig_order as o, preference_swapped_order as s from judged)
    select model, count(*) as n,
      count(*) filter (o = 'A') + count(*) filter (s = 'A') as n_a, count(*) filter (o = 'B') + count(*) filter (s = 'B') as n_b,
      count(*) filter (o = 'FORMAT-ERROR') + count(*) filter (s = 'FORMAT-ERROR') as n_format_error,
      count(*) filter (o = 'API-ERROR') + count(*) filter (s = 'API-ERROR') as n_api_error,
      count(*) filter (preference = -1) as n_first, count(*) filter (preference = 0) as n_none,
      count(*) filter (preference = 1) as n_second,
      {sql_r6("count(*) filter (o in ('A', 'B') and o = s)::double / count(*) filter (o in ('A', 'B') and s in ('A', 'B'))")} as position_bias
    from j group by model""",
)
def a16(spark, d):
    summary = judge.judge_summary(judge.judge_rows(I.raw_answers(spark, d)))
    return summary.withColumn("position_bias", r6("position_bias"))


@query("s4_write_judgements", f"with {I.RAW_ANSWERS}, {SQL_JUDGED} select * from judged")
def s4(spark, d):
    path = io.scratch_path(spark, "judgements")
    io.write_judgements(judge.judge_rows(I.raw_answers(spark, d)), path)
    return io.read_judgements(spark, path)


@query("s4_write_judgements_csv", f"with {I.RAW_ANSWERS}, {SQL_JUDGED} select * from judged")
def s4_csv(spark, d):
    path = io.scratch_path(spark, "judgements-csv")
    io.write_judgements(judge.judge_rows(I.raw_answers(spark, d)), path, "csv")
    return io.read_judgements(spark, path, "csv")


@query("s4_write_judgements_once", f"with {I.RAW_ANSWERS}, {SQL_JUDGED} select * from judged")
def s4_once(spark, d):
    """A job that is run again adds nothing."""
    path = io.scratch_path(spark, "judgements-once")
    for _ in range(2):
        io.write_judgements(judge.judge_rows(I.raw_answers(spark, d)), path, job="run-1")
    return io.read_judgements(spark, path)


@query(
    "questions_to_ask",
    f"""with {MARKED_TEXTS}, {_sql_models()},
    q as (select m.model, 'train' as split, p.pair_id as index, conv, response_1, response_2
          from parsed p join (values ('GPT-4o'), ('Llama-3-8B'), ('Gemma-2B')) m(model) on true)
    select model, split, index, md5({sql_judge_prompt('response_1', 'response_2')}) as prompt_orig,
           md5({sql_judge_prompt('response_2', 'response_1')}) as prompt_swapped
    from q where model in (select model from models where error is null and coalesce(vendor, 'together') = 'together')
      and {H(28, 'index')} % 4 <> 0""",
)
def to_ask(spark, d):
    asked = F.explode(F.array(F.lit("GPT-4o"), F.lit("Llama-3-8B"), F.lit("Gemma-2B"))).alias("model")
    rows = marked_texts(spark, d).select(
        asked, F.lit("train").alias("split"), F.col("pair_id").alias("index"), "prompt", "response_1", "response_2"
    )
    done = rows.where(portable_hash(28, "index") % 4 == 0)
    left = reports.questions_to_ask(rows, done, judge.usable_models(judge.judge_models(spark)))
    return left.withColumns({c: F.md5(c) for c in ("prompt_orig", "prompt_swapped")})
