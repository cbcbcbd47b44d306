import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from prefops.llm import quality, queries
from prefops.llm.secrets import encoding, masked
from prefops.sources import io
from tests.llm import test_decontaminate, test_jaccard, test_secrets
from tests.llm.common import documents


def test_stages_against_brute_force(spark, sf_dir):
    """Every stage on all that the one before kept; the last gives the ids of the texts that are left."""
    docs = queries.table(spark, sf_dir, "documents")
    left = {r.doc_id: r.text for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, columns = left, docs.columns
        docs = io.written(stage(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(before)
        if name == "byte-level BPE":
            enc = encoding(public_tokenizers.path(queries.BPE_RANKS), public_tokenizers.PATTERN)
            assert {r.doc_id: list(r.ids) for r in rows} == {i: enc.encode_ordinary(t) for i, t in before.items()}
            assert all(r.text_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() for r in rows)
            continue
        assert docs.columns == columns and all(r.n_chars == len(r.text) for r in rows)
        left = {r.doc_id: r.text for r in rows}
        if name == "quality rules":
            trusted = queries.trusted_texts(queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "labels"))
            scored = quality.score_quality(queries.table(spark, sf_dir, "documents"), trusted)
            assert set(left) == {r.doc_id for r in scored.where("kept").collect()} and len(left) > len(before) // 2
        elif name == "n-gram Jaccard join":
            ids = sorted(before)
            groups = test_jaccard.brute([before[i] for i in ids], 5, 80)
            assert left == {i: before[i] for k, i in enumerate(ids) if groups[k][1] == k}
        elif name == "benchmark decontamination":
            hits = {i: test_decontaminate.brute(t, items, 10) for i, t in before.items()}
            assert set(left) == {i for i, (n, n_hit, _) in hits.items() if n_hit <= 0.5 * n}
            assert all((left[i] == before[i]) == (hits[i][1] == 0) for i in left)
            assert all(len(test_decontaminate.words(t)) == hits[i][0] - hits[i][1] for i, t in left.items())
        elif name == "secret scans":
            assert left == {i: masked(t, [(s, e) for s, _, e in test_secrets.brute(t)], "[SECRET]") for i, t in before.items()}


def test_empty_documents_and_other_columns(spark, sf_dir):
    none = documents(spark, [], extra=["kept", "ids"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.count() == 0 and (name == "byte-level BPE" or out.columns == none.columns or set(out.columns) <= set(none.columns)), name


def test_null_texts_and_ids_pass(spark, sf_dir):
    df = documents(spark, [None, "", "some words"]).union(documents(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, df, sf_dir).count() == 4, name


def test_repeated_ids(spark, sf_dir):
    """A text stays even if its id is also that of a duplicate; of identical rows one stays."""
    a, b, c = ("alpha " * 3 + "one two three four five six seven eight nine ten " + x for x in ("alpha", "beta gamma delta " * 4, "zeta eta theta " * 9))
    rows = [(1, a), (5, a), (5, b), (8, c), (8, c), (9, None), (9, ""), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert left.columns == ["doc_id", "text", "lang"]
    got = sorted(((r.doc_id or 0, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (8, c), (9, None), (9, ""), (0, a), (0, a)], key=repr)


def test_encoding_is_written_before_decoding(spark, sf_dir):
    """A plan with both would keep two workers a task."""
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    ids = corpus_pipeline.token_ids(spark, docs, sf_dir)
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    assert {r.doc_id: r.n_tokens for r in ids.collect()}[2] == 0
