"""Scores, rewards, mixtures, losses, statistics and the benchmark report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query, r6, sql_r6
from checks.base import sql_hash as H
from prefops import constants as K
from prefops.functions import scores as S
from prefops.functions.rand import portable_hash
from prefops.operators import benchmark, pairs, ranks, scoring, stats
from prefops.plans import preference_prompts, reports, reward_mixture
from prefops.sources import io

N = len(K.OBJECTIVES)
W = I.drawn_matrix(15, N)
GATE = I.drawn_matrix(20, N)
HIDDEN = I.drawn_matrix(33, 8)
OUT = I.drawn_matrix(34, N, 8)
PENALTIES = [j / 20 for j in range(N)]
PENALTIES[K.VERBOSITY_DIM] = 1.0
TEMPERATURE = 0.5


# A user's model: here, texts scored by their length.


def load_length_model():
    def score(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"reward": frame["text"].str.len() / 100.0, "n": frame["text"].str.count(" ")})

    return score


@query(
    "p1_score_batches",
    f"""select doc_id, lang, {sql_r6('length(text) / 100.0::double')} as reward,
        (length(text) - length(replace(text, ' ', '')))::bigint as n from documents""",
)
def p1(spark, d):
    docs = I.documents(spark, d).select("doc_id", "lang", "text", "n_chars")
    scored = scoring.score_batches(docs, load_length_model, ["text"], "reward double, n long", 256, "n_chars")
    return scored.select("doc_id", "lang", r6("reward").alias("reward"), "n")


# Logits


@query(
    "p2_softmax_pair",
    f"""with {I.LOGITS} select id, {sql_r6('1 / (1 + exp(b1 - a1))')} as p, {sql_r6('1 / (1 + exp((b1 - a1) / 10))')} as p_warm
    from logits""",
)
def p2(spark, d):
    return I.logits(spark, d).select(
        "id", r6(S.softmax_pair("a1", "b1")).alias("p"), r6(S.softmax_pair("a1", "b1", 10)).alias("p_warm")
    )


SQL_DEBIASED = """(1 / (1 + exp(b1 - a1)) + 1 / (1 + exp(a2 - b2))) / 2"""


@query(
    "p3_debiased_preference",
    f"""with {I.LOGITS}
    select id, {sql_r6(SQL_DEBIASED)} as chosen_prob,
           case when a1 - b1 + b2 - a2 = 0 then 0.5::double when a1 - b1 + b2 - a2 > 0 then 1.0::double else 0.0::double end as preference
    from logits""",
)
def p3(spark, d):
    scored = preference_prompts.with_chosen_prob(I.logits(spark, d), "a1", "b1", "a2", "b2")
    return scored.select(
        "id", r6("chosen_prob").alias("chosen_prob"), S.preference_from_logits("a1", "b1", "a2", "b2").alias("preference")
    )


@query(
    "p3_debiased_preference_stored",
    f"""with {I.LOGITS}, p as (select id, (round(1 / (1 + exp(b1 - a1)), 9) + round(1 / (1 + exp(a2 - b2)), 9)) / 2 as p from logits)
    select id, round(p, 10) as chosen_prob, case when p = 0.5 then 0.5::double when p > 0.5 then 1.0::double else 0.0::double end as preference
    from p""",
)
def p3_stored(spark, d):
    """From probabilities stored one per order with nine decimals, so that their mean has ten."""
    both = F.array(F.round(S.softmax_pair("a1", "b1"), 9), F.round(S.softmax_pair("b2", "a2"), 9))
    stored = I.logits(spark, d).select("id", F.posexplode(both).alias("position", "prob_chosen"))
    return pairs.debiased_preference(stored).withColumn("chosen_prob", F.round("chosen_prob", 10))


@query(
    "p5_pair_outcome",
    f"""with {I.BENCHMARK_REWARDS} select id, case when rc > rr then 1.0::double when rc = rr then 0.5::double else 0.0::double end as half,
        case when rc > rr then 1.0::double else 0.0::double end as lose from benchmark_rewards""",
)
def p5(spark, d):
    return I.benchmark_rewards(spark, d).select(
        "id", S.pair_outcome("rc", "rr").alias("half"), S.pair_outcome("rc", "rr", "lose").alias("lose")
    )


# Rewards, gates and mixtures

REWARDS = f"""{I.sql_matrix('w', 15, N)},
reward_rows as (select vec_id as id, w.j, list_inner_product(embedding::double[], w.w) as r from embeddings, w),
rewards as (select id, list(r order by j) as rewards from reward_rows group by id)"""

LOGIT_ROWS = f"""{I.sql_matrix('g', 20, N)},
logit_rows as (select vec_id as id, g.j, list_inner_product(embedding::double[], g.w) / {TEMPERATURE}::double as x from embeddings, g)"""
SQL_SOFTMAX = """gate_rows as (select id, j, exp(x) / sum(exp(x)) over (partition by id) as g from logit_rows),
gates as (select id, list(g order by j) as gate from gate_rows group by id)"""
SQL_PENALTIES = f"[{', '.join(f'{p}::double' for p in PENALTIES)}]"
COEFFICIENTS = f"""coefficients as (
  select id, list_transform(gate, lambda x, i: case when i = {K.VERBOSITY_DIM + 1}
      then x - list_inner_product(gate, {SQL_PENALTIES}) else x end) as coeffs from gates)"""


def rewarded(spark: SparkSession, d: str) -> DataFrame:
    rows = I.table(spark, d, "embeddings")
    return rows.select(
        F.col("vec_id").alias("id"),
        S.objective_rewards("embedding", W).alias("rewards"),
        S.gate_weights("embedding", [(GATE, None)], TEMPERATURE).alias("gate"),
    )


def _long(df: DataFrame, c: str | Column, name: str) -> DataFrame:
    # The outer form: the inner one adds a filter that computes the array a second time.
    return df.select("id", F.posexplode_outer(c).alias("j", "v")).select("id", "j", r6("v").alias(name))


@query("p6_objective_rewards", f"with {REWARDS} select id, j::int as j, {sql_r6('r')} as reward from reward_rows")
def p6(spark, d):
    return _long(rewarded(spark, d), "rewards", "reward")


@query(
    "p7_verbosity_transform",
    f"""with {REWARDS} select a.id, a.j::int as j, {sql_r6(f'a.r - {SQL_PENALTIES}[a.j + 1] * b.r')} as reward
    from reward_rows a join reward_rows b on a.id = b.id and b.j = {K.VERBOSITY_DIM}""",
)
def p7(spark, d):
    return _long(rewarded(spark, d), S.verbosity_transform("rewards", PENALTIES), "reward")


@query(
    "p8_gate_weights",
    f"with {LOGIT_ROWS}, {SQL_SOFTMAX} select id, j::int as j, {sql_r6('g')} as gate from gate_rows",
)
def p8(spark, d):
    return _long(rewarded(spark, d), "gate", "gate")


@query(
    "p8_gate_weights_deep",
    f"""with {I.sql_matrix('h', 33, 8)}, {I.sql_matrix('o', 34, N, 8)},
    hidden as (select vec_id as id, list(greatest(list_inner_product(embedding::double[], h.w), 0.0::double) order by h.j) as x
               from embeddings, h group by vec_id),
    logit_rows as (select id, o.j, list_inner_product(x, o.w) / {TEMPERATURE}::double as x from hidden, o), {SQL_SOFTMAX}
    select id, j::int as j, {sql_r6('g * 2')} as gate from gate_rows""",
)
def p8_deep(spark, d):
    rows = I.table(spark, d, "embeddings")
    gate = S.gate_weights("embedding", [(HIDDEN, None), (OUT, None)], TEMPERATURE, logit_scale=2.0)
    return _long(rows.select(F.col("vec_id").alias("id"), gate.alias("gate")), "gate", "gate")


@query(
    "p9_mixture_score",
    f"""with {REWARDS}, {LOGIT_ROWS}, {SQL_SOFTMAX}, {COEFFICIENTS}
    select r.id, {sql_r6('list_inner_product(rewards, gate)')} as score,
           {sql_r6('list_inner_product(rewards, coeffs)')} as debiased_score
    from rewards r join gates g on r.id = g.id join coefficients c on r.id = c.id""",
)
def p9(spark, d):
    return rewarded(spark, d).select(
        "id",
        r6(S.mixture_score("rewards", "gate")).alias("score"),
        r6(S.mixture_score("rewards", "gate", PENALTIES)).alias("debiased_score"),
    )


@query(
    "p10_top_objectives",
    f"""with {LOGIT_ROWS}, {SQL_SOFTMAX}, {COEFFICIENTS}, c as (
      select id, unnest(range({N})) as idx, unnest(coeffs) as c from coefficients)
    select id, (row_number() over (partition by id order by abs(c) desc, idx))::int - 1 as place, idx::int as idx,
           ({'[' + ', '.join(f"'{o}'" for o in K.OBJECTIVES) + ']'})[idx + 1] as name, {sql_r6('c')} as coeff
    from c qualify place < 3""",
)
def p10(spark, d):
    best = S.top_objectives(S.mixture_coefficients("gate", PENALTIES))
    rows = rewarded(spark, d).select("id", F.posexplode_outer(best).alias("place", "o"))
    return rows.select("id", "place", "o.idx", "o.name", r6("o.coeff").alias("coeff"))


@query(
    "p11_denormalize",
    f"with {REWARDS} select id, j::int as j, {sql_r6('r * 5 - 0.5')} as reward from reward_rows where j < 5",
)
def p11(spark, d):
    return _long(rewarded(spark, d), S.denormalize("rewards"), "reward")


# Benchmark report

SQL_REGISTRY = "registry as (select * from (values {}) r(subset, section, example_count))"


def sql_registry(counts: dict | None = None) -> str:
    rows = ", ".join(f"('{s}', '{sec}', {(counts or {}).get(s, n)})" for s, sec, n in K.BENCHMARK_SUBSETS)
    return SQL_REGISTRY.format(rows)


def sql_accuracy(ties: float = 0.5) -> str:
    return f"""accuracy as (
      select r.section, r.subset, r.example_count, count(b.id) as n,
             avg(case when rc > rr then 1.0::double when rc = rr then {ties}::double when rc < rr then 0.0::double end) as accuracy
      from registry r left join benchmark_rewards b on b.subset = r.subset group by all)"""


SQL_SECTION = """coalesce(100 * sum(accuracy * example_count) / sum(case when accuracy is not null then example_count end), 0)"""


def _correct(spark: SparkSession, d: str) -> DataFrame:
    return I.benchmark_rewards(spark, d).withColumn("correct", S.pair_outcome("rc", "rr"))


@query(
    "a1_subset_accuracy",
    f"with {I.BENCHMARK_REWARDS}, {sql_registry()}, {sql_accuracy()} select section, subset, example_count, n, {sql_r6('accuracy')} as accuracy from accuracy",
)
def a1(spark, d):
    out = benchmark.subset_accuracy(_correct(spark, d), benchmark.benchmark_registry(spark))
    return out.withColumn("accuracy", r6("accuracy"))


@query(
    "a1_subset_accuracy_absent",
    f"""with {I.BENCHMARK_REWARDS.replace("doc_id % 23", "doc_id % 8")}, {sql_registry()}, {sql_accuracy()}
    select section, subset, example_count, n, {sql_r6('accuracy')} as accuracy from accuracy""",
)
def a1_absent(spark, d):
    """All rows under the first eight subsets, so that the others have none."""
    names = F.array(*[F.lit(s) for s, _, _ in K.BENCHMARK_SUBSETS])
    rows = _correct(spark, d).withColumn("subset", F.get(names, (F.col("id") % 8).cast("int")))
    out = benchmark.subset_accuracy(rows, benchmark.benchmark_registry(spark))
    return out.withColumn("accuracy", r6("accuracy"))


@query(
    "a2_section_scores",
    f"""with {I.BENCHMARK_REWARDS}, {sql_registry()}, {sql_accuracy()}
    select section, round({SQL_SECTION}, 2) as score from accuracy group by section""",
)
def a2(spark, d):
    return reports.benchmark_report(I.benchmark_rewards(spark, d), benchmark.benchmark_registry(spark))


@query(
    "a2_section_scores_pairwise",
    f"""with {I.BENCHMARK_REWARDS}, {sql_registry(K.PAIRWISE_COUNTS)}, {sql_accuracy(0.5)}
    select section, round({SQL_SECTION}, 2) as score from accuracy group by section""",
)
def a2_pairwise(spark, d):
    registry = benchmark.benchmark_registry(spark, K.PAIRWISE_COUNTS)
    return reports.benchmark_report(I.benchmark_rewards(spark, d), registry, ties="half", decimals=2)


SQL_REPORT = f"""with {I.BENCHMARK_REWARDS}, {sql_registry()}, {sql_accuracy()},
    sections as (select section, round({SQL_SECTION}, 2) as score from accuracy group by section)"""
# The overall score is that of sections before rounding, where a tie is a loss.
SQL_STRICT = f"""with {I.BENCHMARK_REWARDS}, {sql_registry()}, {sql_accuracy(0.0)},
    sections as (select section, {SQL_SECTION} as score from accuracy group by section)"""


def strict_sections(spark: SparkSession, d: str) -> DataFrame:
    return reports.benchmark_report(I.benchmark_rewards(spark, d), benchmark.benchmark_registry(spark), ties="lose", decimals=None)


@query("a3_overall_score", f"{SQL_STRICT} select round(avg(score), 2) as score from sections")
def a3(spark, d):
    return benchmark.overall_score(strict_sections(spark, d))


@query(
    "benchmark_report",
    f"{SQL_STRICT} select section, round(score, 2) as score from sections union all select 'Score', round(avg(score), 2) from sections",
)
def report(spark, d):
    return reports.report_with_overall(strict_sections(spark, d))


@query(
    "s6_append_record",
    f"""{SQL_REPORT} select m.model, section, score from sections, (values ('first'), ('second')) m(model)""",
)
def s6(spark, d):
    path = io.scratch_path(spark, "records")
    sections = io.written(a2(spark, d), "sections")
    io.append_record(sections, path, "first")
    io.append_record(sections, path, "second")
    return io.read_split(spark, path)


@query(
    "s6_append_record_once",
    f"""{SQL_REPORT} select m.model, section, score from sections, (values ('first'), ('second')) m(model)""",
)
def s6_once(spark, d):
    """Two jobs, the first of which runs again."""
    path = io.scratch_path(spark, "records-once")
    sections = io.written(a2(spark, d), "sections")
    for model in ("first", "second", "first"):
        io.append_record(sections, path, model, job=model)
    return io.read_split(spark, path)


# Losses and statistics


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of three attributes under three alphas; one label in five is unknown."""
    rows = I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        (portable_hash(35, "o_orderkey") % 3).cast("int").alias("attr"),
        F.when(portable_hash(36, "o_orderkey") % 5 != 0, (portable_hash(37, "o_orderkey") % 100) / 100.0).alias("label"),
        F.explode(F.array(F.lit(0.1), F.lit(1.0), F.lit(10.0))).alias("alpha"),
    )
    noise = portable_hash(38, "id", (F.col("alpha") * 10).cast("int"))
    return rows.withColumn("pred", (noise % 100) / 100.0)


PREDICTIONS = f"""predictions as (
  select o_orderkey as id, ({H(35, 'o_orderkey')} % 3)::int as attr, alpha,
         case when {H(36, 'o_orderkey')} % 5 <> 0 then ({H(37, 'o_orderkey')} % 100) / 100.0::double end as label,
         ({H(38, 'o_orderkey', '(alpha * 10)::int')} % 100) / 100.0::double as pred
  from orders, (values (0.1::double), (1.0::double), (10.0::double)) a(alpha)),
mse as (select attr, alpha, avg((label - pred) ** 2) as loss, count(label) as n from predictions where label is not null group by all)"""


@query("a5_mse", f"with {PREDICTIONS} select attr, alpha, {sql_r6('loss')} as loss, n from mse")
def a5(spark, d):
    return stats.mse(predictions(spark, d)).withColumn("loss", r6("loss"))


@query(
    "a6_argmin_by_group",
    f"with {PREDICTIONS} select attr, arg_min(alpha, (loss, alpha)) as alpha, {sql_r6('min(loss)')} as loss from mse group by attr",
)
def a6(spark, d):
    return stats.argmin_by_group(stats.mse(predictions(spark, d))).withColumn("loss", r6("loss"))


def sql_rank(value: str, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    same = f"partition by {by + ', ' if by else ''}{value}"
    return f"(rank() over ({part} order by {value}) + (count(*) over ({same}) - 1) / 2.0::double)"


@query(
    "a7_spearman",
    f"""with r as (select {sql_rank('n_chars % 1000')} as x, {sql_rank("length(text) - length(replace(text, ' ', ''))")} as y from documents)
    select {sql_r6('corr(x, y)')} as corr from r""",
)
def a7(spark, d):
    docs = I.documents(spark, d)
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = docs.select("doc_id", (F.col("n_chars") % 1000).alias("x"), blanks.alias("y"))
    return ranks.spearman(rows, "x", "y", "doc_id").select(r6("corr").alias("corr"))


@query(
    "a7_spearman_ties",
    f"""with {I.RAW_ANSWERS}, v as (select {H(39, 'index')} % 3 as x, length(response_orig) as y from raw_answers),
    r as (select {sql_rank('x')} as x, {sql_rank('y')} as y from v) select {sql_r6('corr(x, y)')} as corr from r""",
)
def a7_ties(spark, d):
    rows = I.raw_answers(spark, d).select(
        "index", (portable_hash(39, "index") % 3).alias("x"), F.length("response_orig").alias("y")
    )
    return ranks.spearman(rows, "x", "y", "index").select(r6("corr").alias("corr"))


N_PENALISED = N
PENALISED = f"""{I.sql_matrix('w', 15, N_PENALISED)}, {I.PAIR_EMBEDDINGS},
sides as (select pair_id, 'c' as side, chosen_emb as e from pair_embeddings union all
          select pair_id, 'r', rejected_emb from pair_embeddings),
reward_rows as (select pair_id, side, w.j, round(list_inner_product(e::double[], w.w), 9) as r from sides, w),
tried as (select a.j, p, round(a.r - p * b.r, 9) as x, b.r as y
          from reward_rows a join reward_rows b on a.pair_id = b.pair_id and a.side = b.side and b.j = {K.VERBOSITY_DIM}
          join (select unnest([{', '.join(f'{p}::double' for p in K.VERBOSITY_GRID)}]) as p) on true where a.j <> {K.VERBOSITY_DIM}),
ranked as (select j, p, {sql_rank('x', 'j, p')} as x, {sql_rank('y', 'j, p')} as y from tried),
corrs as (select j, p, corr(x, y) as c from ranked group by j, p),
found as (select j, min(p) filter (c <= THRESHOLD) as p, arg_min(c, p) filter (c <= THRESHOLD) as c, min(c) as least from corrs group by j)"""
SQL_FOUND = f"""select j::int as objective, coalesce(p, 1.0::double) as penalty, {sql_r6('coalesce(c, least(least, 1.0))')} as corr from found
    union all select {K.VERBOSITY_DIM}, 1.0, 1.0"""


def _penalties(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    rows = reward_mixture.pooled_rewards(I.pair_embeddings(spark, d), W[:N_PENALISED])
    out = ranks.verbosity_penalties(rows, objectives=N_PENALISED, threshold=threshold)
    return out.withColumn("corr", r6("corr"))


@query("a8_verbosity_penalties", f"with {PENALISED.replace('THRESHOLD', '0.03')} {SQL_FOUND}")
def a8(spark, d):
    return _penalties(spark, d, 0.03)


@query("a8_verbosity_penalties_strict", f"with {PENALISED.replace('THRESHOLD', '-0.5')} {SQL_FOUND}")
def a8_strict(spark, d):
    return _penalties(spark, d, -0.5)


HEADS = f"""heads as (select doc_id as id, n_chars as length, n_chars / 100.0::double + {H(40, 'doc_id')} % 100 as head0,
                     ({H(41, 'doc_id')} % 1000) / 100.0::double as head1, 1.0::double as flat from documents)"""


def heads(spark: SparkSession, d: str) -> DataFrame:
    return I.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("n_chars").alias("length"),
        (F.col("n_chars") / 100.0 + portable_hash(40, "doc_id") % 100).alias("head0"),
        ((portable_hash(41, "doc_id") % 1000) / 100.0).alias("head1"),
        F.lit(1.0).alias("flat"),
    )


@query(
    "a9_length_bias",
    f"""with {HEADS} select {sql_r6('corr(length, head0)')} as corr_head0, {sql_r6('corr(length, head1)')} as corr_head1,
        {sql_r6('1 - corr(length, head0)')} as loss_follow, {sql_r6('abs(corr(length, head1))')} as loss_avoid from heads""",
)
def a9(spark, d):
    out = stats.length_bias(heads(spark, d))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "a9_length_bias_constant",
    f"""with {HEADS} select {sql_r6('corr(length, head0)')} as corr_head0, null::double as corr_flat,
        {sql_r6('1 - corr(length, head0)')} as loss_follow, null::double as loss_avoid from heads""",
)
def a9_constant(spark, d):
    out = stats.length_bias(heads(spark, d), heads=("head0", "flat"))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "a10_bt_loss",
    f"""with {I.LOGITS} select {sql_r6('avg(greatest(b1 - a1, 0) + ln(1 + exp(-abs(a1 - b1))))')} as loss, count(*) as n from logits""",
)
def a10(spark, d):
    return stats.bt_loss(I.logits(spark, d), "a1", "b1").withColumn("loss", r6("loss"))


def two_heads(spark: SparkSession, d: str) -> DataFrame:
    rows = I.logits(spark, d)
    return rows.select(
        F.floor(F.col("id") / 16).cast("long").alias("batch"),
        (portable_hash(42, "id") % 500).alias("length_chosen"),
        (portable_hash(43, "id") % 500).alias("length_rejected"),
        F.array("a1", "a2").alias("chosen"),
        F.array("b1", "b2").alias("rejected"),
    )


TWO_HEADS = f"""{I.LOGITS}, rows as (
  select id // 16 as batch, {H(42, 'id')} % 500 as lc, {H(43, 'id')} % 500 as lr, a1, a2, b1, b2, a1 + a2 - b1 - b2 as gap from logits),
sides as (select batch, lc as len, a1 as h0, a2 as h1 from rows union all select batch, lr, b1, b2 from rows),
lengths as (select batch, 1 - corr(len, h0) as follow, abs(corr(len, h1)) as avoid from sides group by batch),
ranking as (select batch, count(*) as n, sum(gap) as gap, avg(greatest(-gap, 0) + ln(1 + exp(-abs(gap)))) as mean from rows group by batch),
both_terms as (select r.batch, n, greatest(-gap, 0) + ln(1 + exp(-abs(gap))) as whole, mean, follow, avoid
         from ranking r join lengths l on l.batch = r.batch)"""


def sql_two_heads(term: str, weight: float) -> str:
    return f"""with {TWO_HEADS} select batch, n, {sql_r6(term)} as ranking_loss, {sql_r6('follow')} as loss_follow,
        {sql_r6('avoid')} as loss_avoid, {sql_r6(f'{term} + {weight} * (follow + avoid)')} as loss from both_terms"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("batch", "n", *[r6(c).alias(c) for c in ("ranking_loss", "loss_follow", "loss_avoid", "loss")])


@query("a11_two_head_loss", sql_two_heads("whole", 1.0))
def a11(spark, d):
    return _rounded(stats.two_head_loss(two_heads(spark, d)))


@query("a11_two_head_loss_per_pair", sql_two_heads("mean", 0.5))
def a11_pair(spark, d):
    return _rounded(stats.two_head_loss(two_heads(spark, d), weight=0.5, per_pair=True))


@query(
    "a12_bce_loss",
    f"""with {I.LOGITS}, p as (select label, 1 / (1 + exp(-a1)) as p from logits)
    select {sql_r6('avg(-(label * ln(p + 1e-10) + (1 - label) * ln(1 - p + 1e-10)))')} as loss, count(*) as n from p""",
)
def a12(spark, d):
    return stats.bce_loss(I.logits(spark, d), "label", "a1").withColumn("loss", r6("loss"))


@query(
    "a13_length_stats",
    f"""with {I.TOKEN_IDS} select count(*) as n, max(length) as max_length, {sql_r6('avg(length)')} as mean_length,
        count(*) filter (length <= 200) as n_kept from token_ids""",
)
def a13(spark, d):
    return pairs.length_stats(I.token_ids(spark, d), 200).withColumn("mean_length", r6("mean_length"))
