import pytest
from pyspark.sql import functions as F

from prefops.functions import scores as S
from prefops.functions import text as X
from prefops.functions.rand import coin
from prefops.operators import augment, ordering, pairs
from prefops.plans import preference_prompts
from prefops.schema import STANDARD_PAIR

U, A = "user", "assistant"


def turns(*contents, first=U):
    roles = [U, A] if first == U else [A, U]
    return [{"role": roles[i % 2], "content": c} for i, c in enumerate(contents)]


CASES = {
    "valid": (None, turns("q", "a"), turns("q", "b")),
    "valid_long": (None, turns("q", "a", "r", "x"), turns("q", "a", "r", "y")),
    "same_answers": (None, turns("q", "a"), turns("q", "a")),
    "no_turns": ("empty", [], []),
    "null": ("empty", None, turns("q", "a")),
    "odd": ("odd_length", turns("q"), turns("q")),
    "lengths": ("length_differs", turns("q", "a"), turns("q", "a", "r", "y")),
    "system": ("roles", [{"role": "system", "content": "s"}, {"role": A, "content": "a"}], turns("s", "a")),
    "two_users": ("roles", turns("q", "a"), [{"role": U, "content": "q"}, {"role": U, "content": "b"}]),
    "swapped": ("roles", turns("q", "a", first=A), turns("q", "b", first=A)),
    "blank": ("empty_content", turns("q", ""), turns("q", "b")),
    "context": ("context_differs", turns("q", "a", "r", "x"), turns("p", "a", "r", "x")),
}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, c, r) for i, (_, c, r) in enumerate(CASES.values())]
    return spark.createDataFrame(rows, STANDARD_PAIR)


def test_reject_reasons(cases):
    got = {r["pair_id"]: r["reject_reason"] for r in pairs.pair_reject_reason(cases).collect()}
    assert [got[i] for i in range(len(CASES))] == [why for why, _, _ in CASES.values()]


def test_valid_pairs_are_those_without_reason(cases):
    assert sorted(r["pair_id"] for r in pairs.valid_pairs(cases).collect()) == [0, 1, 2]


def test_missing_column_is_an_error(cases):
    with pytest.raises(ValueError, match="missing columns"):
        pairs.pair_prompt(cases.drop("pair_id"))


def test_prompt_puts_label_on_the_chosen_side(spark):
    rows = [(i, turns(f"q{i}", "good"), turns(f"q{i}", "bad")) for i in range(200)]
    made = pairs.pair_prompt(spark.createDataFrame(rows, STANDARD_PAIR)).collect()
    labels = []
    for r in made:
        prompt, label = r["messages"][0]["content"], r["messages"][1]["content"]
        a, b = ("good", "bad") if label == "A" else ("bad", "good")
        assert prompt == f"[CONTEXT] \n\n<turn> user\n q{r['pair_id']}\n [RESPONSE A] {a} [RESPONSE B] {b} \n"
        labels.append(label)
    assert 60 < labels.count("A") < 140


def test_confident_pairs_keep_or_swap(spark):
    rows = [(1, "c", "r", 0.9), (2, "c", "r", 0.1), (3, "c", "r", 0.8), (4, "c", "r", 0.5)]
    df = spark.createDataFrame(rows, "pair_id int, chosen string, rejected string, chosen_prob double")
    kept = sorted(tuple(r) for r in pairs.confident_pairs(df).collect())
    assert kept == [(1, "c", "r", 0.9), (2, "c", "r", 0.1)]
    swapped = sorted(tuple(r) for r in pairs.confident_pairs(df, relabel=True).collect())
    assert swapped == [(1, "c", "r", 0.9), (2, "r", "c", 0.9)]


def test_unpivot_orders_and_back(spark):
    df = spark.createDataFrame([(1, "c1", "r1"), (2, "c2", "r2")], "pair_id int, chosen string, rejected string")
    rows = pairs.unpivot_pairs(df, order=("rejected", "chosen"))
    assert [tuple(r) for r in rows.where("pair_id = 1").orderBy("position").collect()] == [
        (1, 0, "rejected", 0, "r1"),
        (1, 1, "chosen", 1, "c1"),
    ]
    assert sorted(map(tuple, pairs.repivot_pairs(rows).collect())) == sorted(map(tuple, df.collect()))


def test_length_filter_runs_before_the_model(spark):
    rows = [(1, turns("q", "a"), turns("q", "b")), (2, turns("q", "w " * 50), turns("q", "b"))]
    seen = []

    def score(df):
        seen.extend(r["pair_id"] for r in df.select("pair_id").collect())
        return df.withColumn("chosen_prob", F.lit(0.99))

    out = preference_prompts.pseudo_labelled_prompts(spark.createDataFrame(rows, STANDARD_PAIR), score, max_len=30)
    assert seen == [1]
    assert out.count() == 1


def test_swapping_the_sides_mirrors_the_probability(spark):
    df = spark.createDataFrame([(2.0, -1.0, 0.5, 0.25)], "a1 double, b1 double, a2 double, b2 double")
    p, q = df.select(S.debiased_prob("a1", "b1", "a2", "b2"), S.debiased_prob("a2", "b2", "a1", "b1")).first()
    assert p + q == pytest.approx(1.0)


# Order


def test_shuffle_index_is_the_global_order(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"]: r["shuffle_index"] for r in ordering.shuffle_index(df, "k", 7).collect()}
    assert sorted(got.values()) == list(range(5000))
    import hashlib

    want = sorted(range(5000), key=lambda k: (int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:8], 16), k))
    assert [got[k] for k in want] == list(range(5000))


def test_index_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = ordering.shuffle_index(df.repartition(3), "id").orderBy("id").collect()
    b = ordering.shuffle_index(df.repartition(11), "id").orderBy("id").collect()
    assert a == b


@pytest.mark.parametrize(("bits", "bound"), [(12, 10**6), (2, 1), (2, 300), (4, 0), (16, 0)])
def test_index_at_any_depth(spark, bits, bound):
    df = spark.range(1200).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("wide").alias("text"))
    key = df.select("k")
    want = {r["k"]: r["i"] for r in ordering.dense_index(key, "k", 3, "i").collect()}
    got = ordering.dense_index(df, "k", 3, "i", bits, bound)
    assert got.columns == ["k", "text", "i"]
    assert {r["k"]: r["i"] for r in got.collect()} == want
    assert sorted(want.values()) == list(range(1200))


def test_a_null_key_has_its_place(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "k long, _k string")
    assert sorted(r["i"] for r in ordering.dense_index(df, "k", 3, "i").collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="key repeats: null"):
        ordering.dense_index(df.union(df.where("k is null")), "k", 3, "i").collect()


def test_only_keys_are_ranked(spark, tmp_path):
    """Whole rows pass through no window, and one exchange at most, that of the join by key."""
    spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 100)).write.parquet(str(tmp_path / "t"))
    df = ordering.dense_index(spark.read.parquet(str(tmp_path / "t")), "id", 3)
    plan = df._jdf.queryExecution().optimizedPlan()
    assert "text" in plan.output().mkString()

    def windows(node):
        if node.nodeName() == "Window":
            yield node.child().output().mkString()
        for i in range(node.children().size()):
            yield from windows(node.children().apply(i))

    found = list(windows(plan))
    assert len(found) >= 3 and not any("text" in w for w in found)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert sum("text" in line for line in physical.splitlines() if "Exchange" in line) <= 1


@pytest.mark.parametrize(("n", "frac"), [(1000, 0.2), (7, 0.2), (1, 0.2), (10, 0.0), (10, 1.0), (0, 0.2)])
def test_split_sizes_are_exact(spark, n, frac):
    import math

    df = spark.range(n).withColumnRenamed("id", "k")
    got = ordering.train_val_split(df, "k", frac)
    assert got.where("is_val").count() == math.ceil(n * frac)
    assert got.count() == n


def test_split_takes_the_first_in_shuffle_order(spark):
    df = spark.range(3000)
    val = {r["id"] for r in ordering.train_val_split(df, "id", 0.3, 5).where("is_val").collect()}
    first = {r["id"] for r in ordering.shuffle_index(df, "id", 5).where("shuffle_index < 900").collect()}
    assert val == first


def test_split_works_on_strings(spark):
    df = spark.range(100).select(F.concat(F.lit("k"), "id").alias("k"))
    assert ordering.train_val_split(df, "k").where("is_val").count() == 20


def test_shards_cover_all_rows_once(spark):
    df = spark.range(103)
    parts = [[r["id"] for r in ordering.shard(df, 4, i, "id").collect()] for i in range(4)]
    assert sorted(sum(parts, [])) == list(range(103))
    assert {len(p) for p in parts} == {25, 26}
    with pytest.raises(ValueError):
        ordering.shard(df, 4, 4, "id")


# Augmentation


def prompt_row(i, content, label):
    return (i, [{"role": U, "content": content}, {"role": A, "content": label}])


PROMPTS = "id long, messages array<struct<role:string,content:string>>"


def test_parse_prompts_and_rejects(spark):
    ok = "[CONTEXT] c [RESPONSE A] x [RESPONSE B] y \n"
    rows = [
        prompt_row(1, ok, "A"),
        prompt_row(2, ok, "B"),
        prompt_row(3, ok, "Same"),
        prompt_row(4, ok, "C"),
        prompt_row(5, "[CONTEXT] c [RESPONSE A] x", "A"),
        prompt_row(6, "[CONTEXT] c [RESPONSE A] x [RESPONSE A] z [RESPONSE B] y", "A"),
        (7, []),
    ]
    df = spark.createDataFrame(rows, PROMPTS)
    got = {r["id"]: tuple(r)[1:] for r in augment.parse_pair_prompt(df).collect()}
    assert got == {
        1: (" c ", " x ", " y \n", False),
        2: (" c ", " y \n", " x ", False),
        3: (" c ", " x ", " y \n", True),
    }
    assert sorted(r["id"] for r in augment.unparsed_prompts(df).collect()) == [4, 5, 6, 7]


def triples(spark, n):
    rows = [(i, f"c{i}", f"w{i}", f"l{i}", False) for i in range(n)]
    return spark.createDataFrame(rows, "id long, context string, response_w string, response_l string, neutral boolean")


def test_parsing_undoes_rendering(spark):
    df = triples(spark, 50).withColumn("neutral", F.col("id") % 5 == 0)
    back = augment.parse_pair_prompt(augment.render_triple(df, "id"))
    decided = df.where("not neutral")
    assert sorted(map(tuple, back.where("not neutral").collect())) == sorted(map(tuple, decided.collect()))
    assert back.where("neutral").count() == 10


def test_fourteen_rows_eight_decided(spark):
    n = 60
    out = augment.augment_triples(triples(spark, n)).collect()
    assert len(out) == 14 * n
    assert sum(not r["neutral"] for r in out) == 8 * n
    for r in out:
        assert r["context"] == f"c{r['id']}"
        own = {f"w{r['id']}", f"l{r['id']}"}
        if not r["neutral"]:
            assert r["response_w"] in own
    slots = {}
    for r in out:
        slots.setdefault(r["id"], {})[r["slot"]] = (r["response_w"], r["response_l"])
    for i, s in slots.items():
        (w, wj), (_, wk), (_, lj), (_, lk) = s[0], s[1], s[2], s[3]
        assert w == f"w{i}" and lj == "l" + wj[1:] and lk == "l" + wk[1:]
        assert [s[k] for k in range(4, 8)] == [(f"l{i}", x) for x in (wj, wk, lj, lk)]
        assert [s[k] for k in range(8, 14)] == [(wj, lj), (wk, lk), (wj, wk), (wj, lk), (wk, lj), (lj, lk)]


def test_partners_are_permutations(spark):
    got = augment.partners(triples(spark, 100), "id", 0).collect()
    for c in ("id", "id_j", "id_k"):
        assert sorted(r[c] for r in got) == list(range(100))


def test_coin_is_fair_and_fixed(spark):
    df = spark.range(2000).select("id", coin(3, "id").alias("c"))
    heads = df.agg(F.sum("c")).first()[0]
    assert 900 < heads < 1100
    assert df.collect() == df.repartition(5).orderBy("id").collect()


def test_pair_functions_run_on_a_stream(spark, tmp_path):
    rows = [(i, turns("q", "a"), turns("q", "b")) for i in range(5)]
    spark.createDataFrame(rows, STANDARD_PAIR).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(STANDARD_PAIR).parquet(str(tmp_path / "in"))
    made = pairs.pair_prompt(pairs.valid_pairs(stream)).select("pair_id", X.render_turns("messages").alias("t"))
    query = made.writeStream.format("memory").queryName("prompts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("prompts").count() == 5
