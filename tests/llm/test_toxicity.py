import random

import numpy as np

from prefops.llm import toxicity
from tests.llm.common import EDGE_TEXTS, documents

MILD, SEVERE = ["grumpy", "silly", "meh"], ["vile", "foul", "rotten"]


def made(seed, n):
    rng = random.Random(seed)
    texts, grades = [], []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rng.randint(5, 300))]
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range(grade and rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(MILD if grade == 1 else MILD + SEVERE))
        if grade == 2:
            words.insert(0, rng.choice(SEVERE).title())
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, grades


def test_grades_of_texts_not_seen(spark):
    texts, grades = made(1, 1500)
    docs = documents(spark, texts).repartition(4)
    labels = spark.createDataFrame([(i, g if i % 10 else None) for i, g in enumerate(grades) if i < 1000], "doc_id long, grade int")
    model = toxicity.fit(docs, labels)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    unseen = range(1000, 1500)
    assert np.mean([rows[i].toxic == (grades[i] > 0) for i in unseen]) > 0.97
    mean = [np.mean([rows[i].severity for i in unseen if grades[i] == g]) for g in range(3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]


def test_loss_is_at_its_least():
    rng = np.random.default_rng(3)
    x = (rng.random((400, 4)) < 0.3).astype(float)
    y = np.clip((x @ [2.0, 1.0, 0.0, -1.0] + rng.logistic(size=400)).astype(int), 0, 2)

    def loss(w, t):
        c = np.concatenate([np.zeros((400, 1)), 1 / (1 + np.exp((x @ w)[:, None] - t)), np.ones((400, 1))], axis=1)
        return -np.log(c[np.arange(400), y + 1] - c[np.arange(400), y]).sum() + toxicity.L2 / 2 * (w**2).sum()

    w, t = toxicity._cumulative_link(x, y, 3)
    for k in range(4):
        assert loss(w + 0.05 * np.eye(4)[k], t) > loss(w, t) < loss(w - 0.05 * np.eye(4)[k], t)
    for k in range(2):
        assert loss(w, t + 0.05 * np.eye(2)[k]) > loss(w, t) < loss(w, t - 0.05 * np.eye(2)[k])


def test_edges(spark):
    texts, grades = made(2, 300)
    docs = documents(spark, texts)
    rows = [(i, g) for i, g in enumerate(grades)]
    model = toxicity.fit(docs, spark.createDataFrame(rows + rows[:50] + [(None, 2), (10**6, 1)], "doc_id long, grade int"))
    out = toxicity.predict(documents(spark, EDGE_TEXTS, extra=["toxic", "Grade"]), model).collect()
    assert len(out) == len(EDGE_TEXTS) and not any(r.toxic for r in out) and len({r.severity for r in out}) == 1
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, grade int"))
    assert toxicity.predict(docs, one).first().severity == 1.0
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert toxicity.predict(docs, none).first().severity == 0.0
    assert toxicity.predict(documents(spark, []), model).count() == 0
    long = "fine words " * 200_000 + "vile"
    assert toxicity.predict(documents(spark, [long, long]), model).distinct().count() == 2


def test_given_tables_on_labels_not_seen(spark):
    from prefops.llm import queries

    sf_dir = "/root/testdata/sf0.1"
    docs = queries.table(spark, sf_dir, "documents")
    labels = queries.severity_grades(queries.table(spark, sf_dir, "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.predict(docs.join(labels.where("doc_id % 2 = 1").withColumnRenamed("grade", "label"), "doc_id"), model).collect()
    caught = [r.toxic for r in rows if r.label > 0]
    clean = [r.toxic for r in rows if r.label == 0]
    assert sum(caught) >= 0.8 * len(caught) and sum(clean) <= 0.01 * len(clean)
    assert len(queries.QUERIES["op9_toxicity"](spark, sf_dir).collect()) == docs.count()
