"""Sources, pairs, prompts, shuffling and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query, r6, sql_r6, sql_text
from checks.base import sql_hash as H
from prefops import constants as K
from prefops.functions import text as X
from prefops.functions.rand import portable_hash
from prefops.operators import augment, ordering, packing, pairs
from prefops.plans import preference_prompts
from prefops.sources import io, tensors

NL = "chr(10)"
WS = sql_text(K.PY_SPACE)


def sql_render(conv: str) -> str:
    return f"""({NL} || array_to_string(list_transform({conv}, lambda m, i:
        (case when i % 2 = 1 then {sql_text(K.TURN_USER)} else {sql_text(K.TURN_ASSISTANT)} end) || m.content), '') || {NL})"""


def sql_pair_prompt(context: str, good: str, bad: str, coin: str) -> str:
    return f"""('[CONTEXT] ' || {context} || ' [RESPONSE A] ' || case when {coin} = 1 then {bad} else {good} end
        || ' [RESPONSE B] ' || case when {coin} = 1 then {good} else {bad} end || ' ' || {NL})"""


def sql_reason(c: str, r: str) -> str:
    def roles(conv: str) -> str:
        return f"""list_bool_and(list_transform({conv}, lambda m, i:
            m.role = case when i % 2 = 1 then 'user' else 'assistant' end))"""

    def empty(conv: str) -> str:
        return f"len(list_filter({conv}, lambda m: m.content = '')) > 0"

    def context(conv: str) -> str:
        return f"list_transform({conv}[:-2], lambda m: m.content)"

    return f"""case when len({c}) = 0 or len({r}) = 0 then 'empty'
        when len({c}) % 2 <> 0 or len({r}) % 2 <> 0 then 'odd_length'
        when len({c}) <> len({r}) then 'length_differs'
        when not ({roles(c)} and {roles(r)}) then 'roles'
        when {empty(c)} or {empty(r)} then 'empty_content'
        when {context(c)} <> {context(r)} then 'context_differs' end"""


def standard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.to_standard_pairs(I.flat_pairs(spark, d))


# Sources and sinks


@query("s1_read_split", "select doc_id, source, n_chars from documents where source = 'src1'")
def s1(spark, d):
    return io.read_split(spark, f"{d}/documents.parquet", source="src1").select("doc_id", "source", "n_chars")


@query(
    "s2_read_shards",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem",
)
def s2(spark, d):
    return io.read_shards(spark, f"{d}/lineitem*.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )


@query("s3_write_shards", "select event_id, user_id, event_type, value from events")
def s3(spark, d):
    path = io.scratch_path(spark, "shards")
    io.write_shards(I.table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path, 4, "event_id")
    return io.read_shards(spark, path)


@query("s3_write_shards_once", "select event_id, user_id, event_type, value, 4::bigint as n_shards from events")
def s3_once(spark, d):
    """The job runs twice; its four files hold every row once."""
    path = io.scratch_path(spark, "shards-once")
    rows = I.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for _ in range(2):
        io.write_shards(rows, path, 4, "event_id", name="events")
    files = io.read_shards(spark, f"{path}/events-*-of-00004.parquet")
    shards = files.select(F.input_file_name().alias("f")).agg(F.count_distinct("f")).scalar()
    return files.withColumn("n_shards", shards)


@query(
    "s2_read_tensors",
    f"""select vec_id as ids, len(embedding)::int as width, {sql_r6("list_sum([x::double for x in embedding])")} as total,
       label::float as label, case when vec_id % 5 > 0 then (vec_id % 7)::float end as mark from embeddings""",
)
def s2_tensors(spark, d):
    """Embeddings and labels as shards of tensor files, an unknown label as NaN, read back by ranges of rows."""
    path = io.scratch_path(spark, "tensors")
    known = F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") % 7).cast("float")
    rows = I.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("ids"), F.col("embedding").alias("embeddings"), F.array(F.col("label").cast("float"), known).alias("labels")
    )
    io.write_shards(rows, path, 4, "ids", name="train", kind="tensors")
    back = tensors.read_tensors(spark, f"{path}/train-*.safetensors", ["ids", "embeddings", "labels"], ("labels",), 1 << 20)
    total = F.aggregate("embeddings", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(
        "ids", F.size("embeddings").alias("width"), r6(total).alias("total"), F.col("labels")[0].alias("label"), F.col("labels")[1].alias("mark")
    )


# Filters


@query(
    "f1_to_standard_pairs",
    f"""with {I.FLAT_PAIRS}
    select pair_id, 'user' as role_0, prompt as content_0, 'assistant' as role_1, chosen as chosen_1, rejected as rejected_1
    from flat_pairs""",
)
def f1(spark, d):
    return standard_pairs(spark, d).select(
        "pair_id",
        F.col("chosen")[0]["role"].alias("role_0"),
        F.col("rejected")[0]["content"].alias("content_0"),
        F.col("rejected")[1]["role"].alias("role_1"),
        F.col("chosen")[1]["content"].alias("chosen_1"),
        F.col("rejected")[1]["content"].alias("rejected_1"),
    )


@query(
    "f2_valid_pairs",
    f"""with {I.CONVERSATION_PAIRS}
    select pair_id, len(chosen)::int as turns, rejected[-1].content as last_rejected from conversation_pairs
    where ({sql_reason('chosen', 'rejected')}) is null""",
)
def f2(spark, d):
    return pairs.valid_pairs(I.conversation_pairs(spark, d)).select(
        "pair_id", F.size("chosen").alias("turns"), X.last_content("rejected").alias("last_rejected")
    )


@query(
    "f2b_pair_reject_reason",
    f"""with {I.CONVERSATION_PAIRS}
    select {sql_reason('chosen', 'rejected')} as reject_reason, count(*) as n from conversation_pairs group by 1""",
)
def f2b(spark, d):
    return preference_prompts.reject_counts(I.conversation_pairs(spark, d))


@query("f3_length_at_most", f"with {I.TOKEN_IDS} select id, length from token_ids where length <= 200")
def f3(spark, d):
    return pairs.length_at_most(I.token_ids(spark, d).select("id", "length"), 200)


def _with_lengths(df: DataFrame) -> DataFrame:
    return df.select(
        "pair_id", X.token_length("chosen").alias("chosen_len"), X.token_length("rejected").alias("rejected_len")
    )


SQL_LENGTHS = r"""select pair_id, len(regexp_extract_all(chosen, '\S+'))::int as chosen_len,
    len(regexp_extract_all(rejected, '\S+'))::int as rejected_len from flat_pairs"""


@query(
    "f4_both_sides_within",
    f"with {I.FLAT_PAIRS}, l as ({SQL_LENGTHS}) select * from l where greatest(chosen_len, rejected_len) <= 500",
)
def f4(spark, d):
    return pairs.both_sides_within(_with_lengths(I.flat_pairs(spark, d)), 500)


@query("f5_take", "select event_id, user_id from events order by event_id limit 100")
def f5(spark, d):
    return ordering.take(I.table(spark, d, "events").select("event_id", "user_id"), 100, "event_id")


@query("f9_keep_rate", f"""with {I.LOGITS}, p as (select (1 / (1 + exp(b1 - a1)) + 1 / (1 + exp(a2 - b2))) / 2 as p from logits)
    select count(*) as n, count(*) filter (greatest(p, 1 - p) > 0.8) as n_kept,
           round(100.0::double * count(*) filter (greatest(p, 1 - p) > 0.8) / count(*), 2) as pct_kept from p""")  # fmt: skip
def f9(spark, d):
    return preference_prompts.share_confident(
        preference_prompts.with_chosen_prob(I.logits(spark, d), "a1", "b1", "a2", "b2")
    )


def _scored_flat(spark: SparkSession, d: str) -> DataFrame:
    p = ((portable_hash(23, "pair_id") % 1000) / 999.0).alias("chosen_prob")
    return I.flat_pairs(spark, d).select("pair_id", "chosen", "rejected", p)


SQL_SCORED_FLAT = f"select pair_id, chosen, rejected, ({H(23, 'pair_id')} % 1000) / 999.0::double as p from flat_pairs"


@query(
    "f8_confident_pairs",
    f"""with {I.FLAT_PAIRS}, s as ({SQL_SCORED_FLAT})
    select pair_id, md5(chosen) as chosen, md5(rejected) as rejected, round(p, 6) as chosen_prob
    from s where greatest(p, 1 - p) > 0.8""",
)
def f8(spark, d):
    out = pairs.confident_pairs(_scored_flat(spark, d))
    return out.select(
        "pair_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), F.round("chosen_prob", 6).alias("chosen_prob")
    )


@query(
    "f8_confident_pairs_relabelled",
    f"""with {I.FLAT_PAIRS}, s as ({SQL_SCORED_FLAT})
    select pair_id, md5(case when p < 0.5 then rejected else chosen end) as chosen,
           md5(case when p < 0.5 then chosen else rejected end) as rejected, round(greatest(p, 1 - p), 6) as chosen_prob
    from s where greatest(p, 1 - p) > 0.8""",
)
def f8r(spark, d):
    out = pairs.confident_pairs(_scored_flat(spark, d), relabel=True)
    return out.select(
        "pair_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), F.round("chosen_prob", 6).alias("chosen_prob")
    )


@query(
    "f10_truncate_left",
    f"with {I.TOKEN_IDS} select id, array_to_string(ids[-100:], ',') as ids from token_ids",
)
def f10(spark, d):
    ids = X.truncate_left("ids", 100)
    return I.token_ids(spark, d).select("id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


# Rendering and parsing of pairs


@query(
    "t1_render_turns",
    f"with {I.CONVERSATION_PAIRS} select pair_id, {sql_render('chosen')} as text from conversation_pairs",
)
def t1(spark, d):
    return I.conversation_pairs(spark, d).select("pair_id", X.render_turns("chosen").alias("text"))


SQL_VALID = f"""valid as (select * from conversation_pairs where ({sql_reason('chosen', 'rejected')}) is null)"""


@query(
    "t2_pair_prompt",
    f"""with {I.CONVERSATION_PAIRS}, {SQL_VALID}
    select pair_id,
           {sql_pair_prompt(sql_render('chosen[:-2]'), 'chosen[-1].content', 'rejected[-1].content', f"({H(0, 'pair_id')} % 2)")} as prompt,
           case when {H(0, 'pair_id')} % 2 = 1 then 'B' else 'A' end as label
    from valid""",
)
def t2(spark, d):
    made = pairs.pair_prompt(pairs.valid_pairs(I.conversation_pairs(spark, d)))
    return made.select(
        "pair_id", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("label")
    )


def flat_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise prompts of the flat pairs, a tenth of them labelled as ties."""
    made = pairs.pair_prompt(standard_pairs(spark, d)).withColumnRenamed("pair_id", "id")
    label = F.when(portable_hash(24, "id") % 10 == 0, F.lit("Same")).otherwise(F.col("messages")[1]["content"])
    return made.select("id", X.user_assistant(F.col("messages")[0]["content"], label).alias("messages"))


SQL_COIN = f"({H(0, 'pair_id')} % 2)"
SQL_FLAT_CONTEXT = f"({NL} || {sql_text(K.TURN_USER)} || prompt || {NL})"
FLAT_PROMPTS = f"""{I.FLAT_PAIRS},
flat_prompts as (
  select pair_id as id, {sql_pair_prompt(SQL_FLAT_CONTEXT, 'chosen', 'rejected', SQL_COIN)} as prompt,
         case when {H(24, 'pair_id')} % 10 = 0 then 'Same' when {SQL_COIN} = 1 then 'B' else 'A' end as label
  from flat_pairs),
parts as (select id, label, list_filter(regexp_split_to_array(prompt, '\\[CONTEXT\\]|\\[RESPONSE A\\]|\\[RESPONSE B\\]'),
                                        lambda x: x <> '') as p from flat_prompts),
triples as (
  select id, p[1] as context, case when label = 'B' then p[3] else p[2] end as response_w,
         case when label = 'B' then p[2] else p[3] end as response_l, label = 'Same' as neutral
  from parts where len(p) = 3 and label in ('A', 'B', 'Same'))"""


def _digests(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, *[F.md5(c).alias(c) for c in ("context", "response_w", "response_l")], "neutral"
    )


@query(
    "t3_parse_pair_prompt",
    f"with {FLAT_PROMPTS} select * from triples",
)
def t3(spark, d):
    return augment.parse_pair_prompt(flat_prompts(spark, d))


@query(
    "t3_unparsed_prompts",
    """select doc_id as id from documents where not (doc_id % 2 = 0 and doc_id % 3 <> 0) order by id""",
)
def t3_rejects(spark, d):
    """Of prompts that lack a part, and labels that aren't one, all and no others are told."""
    docs = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    part = lambda s: F.concat(F.lit(s), F.col("id").cast("string"))
    b = F.when(F.col("id") % 2 == 0, part(K.MARK_B)).otherwise(F.lit(""))
    prompt = F.concat(part(K.MARK_CONTEXT), part(K.MARK_A), b)
    label = F.when(F.col("id") % 3 == 0, F.lit("C")).otherwise(F.lit("A"))
    return augment.unparsed_prompts(docs.select("id", X.user_assistant(prompt, label).alias("messages"))).select("id")


def sql_render_triple(coin: str) -> str:
    return f"""'[CONTEXT]' || context || '[RESPONSE A]' || case when {coin} = 1 then response_w else response_l end
        || '[RESPONSE B]' || case when {coin} = 1 then response_l else response_w end as prompt,
        case when neutral then 'Same' when {coin} = 1 then 'A' else 'B' end as label"""


@query(
    "t4_render_triple",
    f"""with {FLAT_PROMPTS} select id, {sql_render_triple(f"({H(0, 'id')} % 2)")} from triples""",
)
def t4(spark, d):
    made = augment.render_triple(augment.parse_pair_prompt(flat_prompts(spark, d)), "id")
    return made.select("id", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("label"))


@query(
    "t14_token_length",
    rf"""with {I.FLAT_PAIRS} select pair_id, len(regexp_extract_all(
        '[CONTEXT] ' || {SQL_FLAT_CONTEXT} || ' [RESPONSE A] ' || chosen || ' [RESPONSE B] ' || rejected, '\S+'))::int as length
    from flat_pairs""",
)
def t14(spark, d):
    return preference_prompts.with_prompt_length(standard_pairs(spark, d)).select("pair_id", "length")


# Combining rows


@query(
    "c1_combine",
    f"""with {I.FLAT_PAIRS}, {I.CONVERSATION_PAIRS}, {SQL_VALID},
    bag as (
      select 'docs:' || pair_id as row_id,
             {sql_pair_prompt(SQL_FLAT_CONTEXT, 'chosen', 'rejected', f"({H('42:docs', 'pair_id')} % 2)")} as prompt,
             case when {H('42:docs', 'pair_id')} % 2 = 1 then 'B' else 'A' end as label
      from flat_pairs where prompt <> '' and chosen <> '' and rejected <> ''
      union all
      select 'talk:' || pair_id,
             {sql_pair_prompt(sql_render('chosen[:-2]'), 'chosen[-1].content', 'rejected[-1].content', f"({H('42:talk', 'pair_id')} % 2)")},
             case when {H('42:talk', 'pair_id')} % 2 = 1 then 'B' else 'A' end
      from valid)
    select row_id, md5(prompt) as prompt, label, row_number() over (order by {H(42, 'row_id')}, row_id) - 1 as shuffle_index
    from bag""",
)
def c1(spark, d):
    bag = preference_prompts.supervised_prompts({"docs": standard_pairs(spark, d), "talk": I.conversation_pairs(spark, d)})
    return bag.select(
        "row_id", F.md5(F.col("messages")[0]["content"]).alias("prompt"), F.col("messages")[1]["content"].alias("label"), "shuffle_index"
    )


SQL_SHUFFLED_ORDERS = f"""select o_orderkey, row_number() over (order by {H(42, 'o_orderkey')}, o_orderkey) - 1 as shuffle_index
    from orders"""


@query("c2_shuffle_index", SQL_SHUFFLED_ORDERS)
def c2(spark, d):
    return ordering.shuffle_index(I.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("c3_shard", f"select * from ({SQL_SHUFFLED_ORDERS}) where shuffle_index % 4 = 1")
def c3(spark, d):
    return ordering.shard(I.table(spark, d, "orders").select("o_orderkey"), 4, 1, "o_orderkey", seed=42)


def sql_is_val(table: str, key: str, seed: int) -> str:
    return f"""row_number() over (order by {H(seed, key)}, {key}) <= ceil(0.2::double * (select count(*) from {table})) as is_val"""


@query("c4_train_val_split", f"select event_id, {sql_is_val('events', 'event_id', 42)} from events")
def c4(spark, d):
    return ordering.train_val_split(I.table(spark, d, "events").select("event_id"), "event_id")


def triples(spark: SparkSession, d: str) -> DataFrame:
    return io.written(augment.parse_pair_prompt(flat_prompts(spark, d)), "triples")


_SLOTS = [(a, b, "false") for a in ("i.response_w", "i.response_l") for b in ("j.response_w", "k.response_w", "j.response_l", "k.response_l")]
_SLOTS += [
    ("j.response_w", "j.response_l", "true"),
    ("k.response_w", "k.response_l", "true"),
    ("j.response_w", "k.response_w", "true"),
    ("j.response_w", "k.response_l", "true"),
    ("k.response_w", "j.response_l", "true"),
    ("j.response_l", "k.response_l", "true"),
]
AUGMENTED = f"""{FLAT_PROMPTS},
placed as (select *, row_number() over (order by {H('0:i', 'id')}, id) as at_i,
                  row_number() over (order by {H('0:j', 'id')}, id) as at_j,
                  row_number() over (order by {H('0:k', 'id')}, id) as at_k from triples),
augmented as ({' union all '.join(
    f"select i.id, {n} as slot, i.context, {w} as response_w, {l} as response_l, {t} as neutral "
    "from placed i join placed j on j.at_j = i.at_i join placed k on k.at_k = i.at_i"
    for n, (w, l, t) in enumerate(_SLOTS))})"""


@query(
    "c5_augment_triples",
    f"""with {AUGMENTED} select id, slot, md5(context) as context, md5(response_w) as response_w,
        md5(response_l) as response_l, neutral from augmented""",
)
def c5(spark, d):
    return _digests(augment.augment_triples(triples(spark, d)), "id", "slot")


@query(
    "c6_augment_prompts",
    f"""with {AUGMENTED}, r as (select id, slot, {sql_render_triple(f"({H(0, 'id', 'slot')} % 2)")} from augmented)
    select id, slot, md5(prompt) as prompt, label from r""",
)
def c6(spark, d):
    made = preference_prompts.augmented_prompts(flat_prompts(spark, d))
    return made.select(
        "id", "slot", F.md5(F.col("messages")[0]["content"]).alias("prompt"), F.col("messages")[1]["content"].alias("label")
    )


@query(
    "c7_unpivot_pairs",
    f"""with {I.FLAT_PAIRS}
    select pair_id, 0 as position, 'rejected' as side, 0 as label, md5(rejected) as value from flat_pairs
    union all select pair_id, 1, 'chosen', 1, md5(chosen) from flat_pairs""",
)
def c7(spark, d):
    sides = pairs.unpivot_pairs(I.flat_pairs(spark, d), order=("rejected", "chosen"))
    return sides.select("pair_id", "position", "side", "label", F.md5("value").alias("value"))


@query("c8_repivot_pairs", f"with {I.BENCHMARK_REWARDS} select id as pair_id, rc as chosen, rr as rejected from benchmark_rewards")
def c8(spark, d):
    rows = I.benchmark_rewards(spark, d).selectExpr("id as pair_id", "rc as chosen", "rr as rejected")
    return pairs.repivot_pairs(pairs.unpivot_pairs(rows))


@query(
    "c11_attach_scores",
    f"""with {I.BENCHMARK_REWARDS} select id, subset, rc from benchmark_rewards where {H(25, 'id')} % 5 <> 0""",
)
def c11(spark, d):
    rows = I.benchmark_rewards(spark, d)
    scores = rows.where(portable_hash(25, "id") % 5 != 0).select("id", "rc")
    return pairs.attach_scores(rows.select("id", "subset"), scores)


@query(
    "c12_pack_sequences",
    f"""with {I.TOKEN_IDS} select count(*) as n_rows, sum(length)::bigint as tokens, 0 as rows_placed_twice,
        0 as blocks_over_limit, 0 as gaps_in_blocks, count_if(length > 4096)::int as blocks_of_a_long_row from token_ids""",
)
def c12(spark, d):
    """Whether every row is placed once, no block is over the limit but those of one long row, and blocks have no gaps."""
    placed = packing.pack_sequences(I.token_ids(spark, d).select("id", "length"), block=4096)
    per_row = placed.groupBy("id").agg(
        F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("block", "length", "offset")]
    )
    blocks = per_row.groupBy("block").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("times") > 1).alias("twice"),
        F.sum("length").alias("tokens"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
    )
    return blocks.agg(
        F.sum("rows").alias("n_rows"),
        F.sum("tokens").alias("tokens"),
        F.sum("twice").cast("int").alias("rows_placed_twice"),
        F.count_if((F.col("tokens") > 4096) & (F.col("rows") > 1)).cast("int").alias("blocks_over_limit"),
        F.count_if((F.col("tokens") > 4096) & (F.col("rows") == 1)).cast("int").alias("blocks_of_a_long_row"),
        F.count_if(F.col("end") != F.col("tokens")).cast("int").alias("gaps_in_blocks"),
    )


@query(
    "pseudo_labelled_prompts",
    rf"""with {I.FLAT_PAIRS}, s as (
      select *, ({H(23, 'pair_id')} % 1000) / 999.0::double as p, len(regexp_extract_all(
        '[CONTEXT] ' || {SQL_FLAT_CONTEXT} || ' [RESPONSE A] ' || chosen || ' [RESPONSE B] ' || rejected, '\S+')) as length
      from flat_pairs where prompt <> '' and chosen <> '' and rejected <> '')
    select pair_id, {sql_pair_prompt(SQL_FLAT_CONTEXT, 'chosen', 'rejected', SQL_COIN)} as prompt,
           case when {SQL_COIN} = 1 then 'B' else 'A' end as label
    from s where length <= 2048 and greatest(p, 1 - p) > 0.8""",
)
def pseudo_labelled(spark, d):
    made = preference_prompts.pseudo_labelled_prompts(
        standard_pairs(spark, d),
        lambda df: df.withColumn("chosen_prob", (portable_hash(23, "pair_id") % 1000) / 999.0),
    )
    return made.select("pair_id", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("label"))
