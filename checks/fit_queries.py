"""Fits on embeddings and what they are used for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks.base import query, r6, sql_r6
from checks.pair_queries import sql_is_val
from checks.score_queries import SQL_SECTION, GATE, N, TEMPERATURE, W, sql_registry
from prefops import constants as K
from prefops.functions import scores as S
from prefops.operators import benchmark, fit, ordering
from prefops.plans import reward_mixture

SQL_RIDGE = f"""split_rows as (select *, {sql_is_val('sparse_objectives', 'id', 42)} from sparse_objectives),
halves as (select *, list_sum(embedding[1:32]::double[]) as x, list_sum(embedding[33:64]::double[]) as z from split_rows),
long as (select x, z, is_val, 0 as attr_idx, a0 as y from halves union all select x, z, is_val, 1, a1 from halves union all
         select x, z, is_val, 2, a2 from halves),
sums as (select attr_idx, is_val, sum(x * x) as xx, sum(x * z) as xz, sum(z * z) as zz, sum(x * y) as xy, sum(z * y) as zy,
                sum(y * y) as yy, count(*) as n from long where y is not null group by all),
solved as (select t.attr_idx, alpha, (xy * (zz + alpha) - zy * xz) / ((xx + alpha) * (zz + alpha) - xz * xz) as w0,
                  (zy * (xx + alpha) - xy * xz) / ((xx + alpha) * (zz + alpha) - xz * xz) as w1
           from sums t, (select unnest([{', '.join(f'{a}::double' for a in K.RIDGE_ALPHAS)}]) as alpha) where not is_val),
path as (select s.*, (v.yy - 2 * (w0 * v.xy + w1 * v.zy) + w0 * w0 * v.xx + 2 * w0 * w1 * v.xz + w1 * w1 * v.zz) / v.n as loss
         from solved s join sums v on v.attr_idx = s.attr_idx and v.is_val)"""


@query(
    "m1_fit_ridge_probe",
    f"""with {I.SPARSE_OBJECTIVES}, {SQL_RIDGE}
    select attr_idx, 'a' || attr_idx as attribute, alpha, {sql_r6('loss')} as loss, {sql_r6('w0')} as w0, {sql_r6('w1')} as w1
    from path qualify row_number() over (partition by attr_idx order by loss, alpha) = 1""",
)
def m1(spark, d):
    """Two features, the sums of both halves of a vector, where the solution has a closed form."""
    half = lambda at: F.aggregate(F.slice("embedding", at, 32), F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = I.sparse_objectives(spark, d).withColumn("embedding", F.array(half(1), half(33)))
    probes = fit.fit_ridge_probe(rows, I.OBJECTIVES_3)
    return probes.select(
        "attr_idx", "attribute", "alpha", r6("loss").alias("loss"), r6(F.col("weight")[0]).alias("w0"), r6(F.col("weight")[1]).alias("w1")
    )


@query(
    "m1_fit_ridge_probe_full",
    f"""with {I.SPARSE_OBJECTIVES}, split_rows as (select *, {sql_is_val('sparse_objectives', 'id', 42)} from sparse_objectives),
    long as (select is_val, unnest([0, 1, 2]) as attr_idx, unnest([a0, a1, a2]) as y from split_rows)
    select attr_idx, 'a' || attr_idx as attribute, count_if(y is not null and not is_val) as n_fitted, 64::bigint as n_weights,
           0.0::double as slope from long group by attr_idx""",
)
def m1_full(spark, d):
    """All features: at the probe's weights the slope of its loss, Xᵀ(Xw - y) + alpha w, is 0 in every direction."""
    rows = I.sparse_objectives(spark, d)
    probes = fit.fit_ridge_probe(rows, I.OBJECTIVES_3)
    labels = F.array(*I.OBJECTIVES_3)
    fitted = ordering.train_val_split(rows, "id").where("not is_val").select("embedding", F.posexplode(labels).alias("attr_idx", "y")).where("y is not null")
    # One probe per attribute.
    told = F.aggregate(F.zip_with("embedding", "weight", lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    met = fitted.join(F.broadcast(probes), "attr_idx").withColumn("miss", told - F.col("y"))
    slopes = met.groupBy("attr_idx", "attribute", "alpha", "weight").agg(
        F.count("*").alias("n_fitted"), F.array(*(F.sum(F.col("miss") * F.get("embedding", F.lit(k))) for k in range(I.DIM))).alias("slopes")
    )
    worst = F.array_max(F.zip_with("slopes", "weight", lambda s, w: F.abs(s + F.col("alpha") * w)))
    return slopes.select("attr_idx", "attribute", "n_fitted", F.size("weight").cast("long").alias("n_weights"), (F.round(worst, 4) + 0.0).alias("slope"))


@query(
    "m2_fit_bt_head",
    f"""with {I.PAIR_EMBEDDINGS} select count(*) as n, true as better_than_nothing, 0.0::double as slope from pair_embeddings""",
)
def m2(spark, d):
    """At the weights of the head its loss is below that of no weights, and its slope is 0 in every direction."""
    pairs = I.pair_embeddings(spark, d)
    model = fit.fit_bt_head(pairs, reg=1e-3)
    gap = F.zip_with("chosen_emb", "rejected_emb", lambda c, r: c.cast("double") - r.cast("double"))
    rows = pairs.select(gap.alias("x"), (fit.head_reward("chosen_emb", model) - fit.head_reward("rejected_emb", model)).alias("gap"))
    return _at_optimum(rows, -1.0 / (1.0 + F.exp("gap")), F.log1p(F.exp(-F.col("gap"))), model, 1e-3)


def _at_optimum(rows: DataFrame, residual: Column, loss: Column, model, reg: float) -> DataFrame:
    weights = F.array(*(F.lit(float(w)) for w in model.coefficients))
    means = rows.agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), F.array(*(F.avg(residual * F.get("x", F.lit(k))) for k in range(I.DIM))).alias("slopes"))
    worst = F.array_max(F.zip_with("slopes", weights, lambda s, w: F.abs(s + reg * w)))
    return means.select("n", (F.col("loss") < math.log(2)).alias("better_than_nothing"), (F.round(worst, 3) + 0.0).alias("slope"))


SQL_GATE = f"with {I.PAIR_EMBEDDINGS} select count(*) as n, true as better_than_start, 0.0::double as loss_gap from pair_embeddings"


def _gate_facts(pairs: DataFrame, **how) -> DataFrame:
    """The fit's own loss must be the one that expressions over the scores give, and below that of the weights it started from."""
    rows = reward_mixture.gate_rows(pairs, W, "pair_id")
    start = fit.fit_gate(rows, N, I.DIM, steps=0, temperature=TEMPERATURE, **how)
    gate = fit.fit_gate(rows, N, I.DIM, lr=0.02, temperature=TEMPERATURE, batch=1024, key="pair_id", **how)
    scored = fit.mixture_pairs(pairs, W, gate.layers, TEMPERATURE)
    loss = F.avg(F.log1p(F.exp(F.col("score_rejected") - F.col("score_chosen"))))
    return scored.agg(
        F.count("*").alias("n"),
        (loss < fit.gate_loss(rows, start)).alias("better_than_start"),
        F.round(F.abs(loss - fit.gate_loss(rows, gate)), 9).alias("loss_gap"),
    )


@query("m3_fit_gate", SQL_GATE)
def m3(spark, d):
    return _gate_facts(I.pair_embeddings(spark, d))


@query("m3_fit_gate_deep", SQL_GATE)
def m3_deep(spark, d):
    """Three hidden layers, as the gate in use has."""
    return _gate_facts(I.pair_embeddings(spark, d), hidden=(32, 32, 32))


def compared(spark: SparkSession, d: str) -> DataFrame:
    """Two answers with the signs of five objectives each; the one preferred is ahead in more of the first three."""
    signs = lambda side: F.transform(S.objective_rewards(f"{side}_emb", W[:5]), lambda r: F.when(r > 0, 1.0).otherwise(0.0))
    five = I.pair_embeddings(spark, d).select("pair_id", signs("chosen").alias("rewards_1"), signs("rejected").alias("rewards_2"))
    ahead = sum((F.signum(F.get("rewards_2", F.lit(k)) - F.get("rewards_1", F.lit(k))) for k in range(3)), start=F.lit(0.0))
    return five.withColumn("preference", (ahead > 0).cast("int"))


SQL_COMPARED = f"""{I.sql_matrix('w', 15, 5)}, {I.PAIR_EMBEDDINGS},
signs as (select pair_id, w.j, (list_inner_product(rejected_emb::double[], w.w) > 0)::int - (list_inner_product(chosen_emb::double[], w.w) > 0)::int as gap
          from pair_embeddings, w where w.j < 3),
compared as (select pair_id, (sum(sign(gap)) > 0)::int as preference from signs group by pair_id)"""


@query("m4_fit_preference_tree", f"with {SQL_COMPARED} select 1.0::double as accuracy, count(*) as n from compared")
def m4(spark, d):
    """The tree learns a rule of a few signs without a mistake."""
    rows = compared(spark, d)
    model = fit.fit_preference_tree(rows, depth=TREE_DEPTH)
    found = fit.preference_from_objectives(rows.withColumnRenamed("preference", "rule"), model)
    return benchmark.mean_accuracy(found, F.col("rule") == F.col("preference"))


#: Two questions for each of the three signs.
TREE_DEPTH = 6


@query("p16_preference_from_objectives", f"with {SQL_COMPARED} select pair_id, preference from compared")
def p16(spark, d):
    rows = compared(spark, d)
    model = fit.fit_preference_tree(rows, depth=TREE_DEPTH)
    return fit.preference_from_objectives(rows.drop("preference"), model).select("pair_id", "preference")


@query("m5_fit_orm_head", "select count(*) as n, true as better_than_nothing, 0.0::double as slope from embeddings")
def m5(spark, d):
    """As for the pairwise head, with labels of single answers."""
    rows = I.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"))
    model = fit.fit_orm_head(rows, reg=1e-3)
    scored = rows.select(F.col("embedding").alias("x"), "label", fit.head_reward("embedding", model).alias("logit"))
    p = 1.0 / (1.0 + F.exp(-F.col("logit")))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1.0 - p))
    return _at_optimum(scored, p - F.col("label"), loss, model, 1e-3)


SQL_MIXTURE = f"""{I.PAIR_EMBEDDINGS}, {I.sql_matrix('w', 15, N)}, {I.sql_matrix('g', 20, N)},
terms as (select pair_id, w.j, list_inner_product(chosen_emb::double[], w.w) as rc, list_inner_product(rejected_emb::double[], w.w) as rr,
                 exp(list_inner_product(chosen_prompt_emb::double[], g.w) / {TEMPERATURE}::double) as e
          from pair_embeddings, w join g on g.j = w.j),
scored as (select pair_id, sum(rc * e) / sum(e) as sc, sum(rr * e) / sum(e) as sr from terms group by pair_id)"""
SUBSETS = [s for s, _, _ in K.BENCHMARK_SUBSETS]


@query(
    "m6_eval_gate",
    f"""with {SQL_MIXTURE}, {sql_registry()},
    accuracy as (select r.section, r.subset, r.example_count, avg(case when sc > sr then 1.0::double when sc <= sr then 0.0::double end) as accuracy
                 from registry r left join scored s
                   on r.subset = ([{', '.join(f"'{s}'" for s in SUBSETS)}])[s.pair_id % {len(SUBSETS)} + 1] group by all)
    select section, {sql_r6(SQL_SECTION)} as score from accuracy group by section""",
)
def m6(spark, d):
    scored = fit.mixture_pairs(I.pair_embeddings(spark, d), W, [(GATE, None)], TEMPERATURE)
    names = F.array(*[F.lit(s) for s in SUBSETS])
    rows = scored.withColumn("subset", F.get(names, (F.col("pair_id") % len(SUBSETS)).cast("int")))
    return fit.eval_gate(rows, benchmark.benchmark_registry(spark)).withColumn("score", r6("score"))


@query(
    "m6_mixture_pairs",
    f"""with {SQL_MIXTURE} select pair_id, {sql_r6('sc')} as score_chosen, {sql_r6('sr')} as score_rejected,
        case when sc > sr then 1.0::double else 0.0::double end as correct from scored""",
)
def m6_pairs(spark, d):
    scored = fit.mixture_pairs(I.pair_embeddings(spark, d), W, [(GATE, None)], TEMPERATURE)
    return scored.select("pair_id", r6("score_chosen").alias("score_chosen"), r6("score_rejected").alias("score_rejected"), "correct")


@query(
    "m6_mixture_pairs_over_sides",
    f"""with {I.PAIR_EMBEDDINGS}, {I.sql_matrix('w', 15, N)}, {I.sql_matrix('g', 20, N)},
    terms as (select pair_id, w.j, list_inner_product(chosen_emb::double[], w.w) as rc, list_inner_product(rejected_emb::double[], w.w) as rr,
                     1 / (1 + exp((list_inner_product(list_reverse(rejected_emb)::double[], g.w)
                                 - list_inner_product(chosen_prompt_emb::double[], g.w)) / {TEMPERATURE}::double)) as s
              from pair_embeddings, w join g on g.j = w.j),
    scored as (select pair_id, sum(rc * s) as sc, sum(rr * (1 - s)) as sr from terms group by pair_id)
    select pair_id, {sql_r6('sc')} as score_chosen, {sql_r6('sr')} as score_rejected,
        case when sc > sr then 1.0::double else 0.0::double end as correct from scored""",
)
def m6_sides(spark, d):
    """With a prompt vector of its own for the rejected side; equal ones would weigh both sides by a half."""
    pairs = I.pair_embeddings(spark, d).withColumn("rejected_prompt_emb", F.reverse("rejected_emb"))
    scored = fit.mixture_pairs(pairs, W, [(GATE, None)], TEMPERATURE, over="sides")
    return scored.select("pair_id", r6("score_chosen").alias("score_chosen"), r6("score_rejected").alias("score_rejected"), "correct")


@query("reward_mixture")
def mixture(spark, d):
    """Probes, penalties and gate in a row, and the accuracy on the left-out pairs."""
    pairs = I.pair_embeddings(spark, d)
    made = reward_mixture.fit_mixture(
        I.sparse_objectives(spark, d), I.OBJECTIVES_3, pairs, dim=2, lr=0.05, temperature=TEMPERATURE
    )
    return reward_mixture.validation_accuracy(pairs, made)
