import itertools
import random

import numpy as np

from prefops.llm import language
from tests.llm.common import EDGE_TEXTS, documents

WORDS = {"en": "the of and house water winter with thing this", "de": "der und nicht wasser haus schnee über straße ich", "ru": "это и вода дом зима снег не", "el": "και το νερό σπίτι"}


def sentences(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_spans_of_mixed_texts(spark):
    rng = random.Random(1)
    train = [(i, sentences(rng, lang, 40), lang, "x") for i, lang in enumerate(list(WORDS) * 20)] + [(99, None, "en", "x"), (98, "some text", None, "x")]
    model = language.fit(table(spark, train).repartition(4))
    assert model.languages == sorted(WORDS)
    en, de, ru = (sentences(rng, x, 30) for x in ("en", "de", "ru"))
    rows = [(0, en, None, ""), (1, f"{en} 12, {de}!", None, ""), (2, f"{ru} {de} {ru}", None, ""), (3, "12 ... !", None, ""), (4, None, None, ""), (5, "και", None, ""), (6, "한국어", None, "")]
    got = {r.doc_id: r for r in language.identify(table(spark, rows), model).collect()}
    assert [(s.lang, s.start, s.end) for s in got[0].lang_spans] == [("en", 0, len(en))] and got[0].score == 1.0
    assert [(s.lang, s.start, s.end) for s in got[1].lang_spans] == [("en", 0, len(en)), ("de", len(en) + 5, len(en) + 5 + len(de))]
    assert [s.lang for s in got[2].lang_spans] == ["ru", "de", "ru"] and got[2].lang_pred == "ru" and 0.4 < got[2].score < 0.9
    assert [(got[i].lang_pred, got[i].score, got[i].lang_spans) for i in (3, 4)] == [("und", 0.0, [])] * 2
    assert got[5].lang_pred == "el" and got[6].lang_pred in WORDS


def brute_path(scores, penalty):
    n, width = scores.shape
    return max(sum(scores[t, p[t]] for t in range(n)) - penalty * sum(a != b for a, b in itertools.pairwise(p)) for p in itertools.product(range(width), repeat=n))


def test_paths_are_the_best(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 7, 12)
        first = np.append(0, np.cumsum(sizes))
        scores = rng.integers(-20, 0, (first[-1], 3))
        penalty = int(rng.integers(1, 15))
        path = language.viterbi(scores, first, penalty)
        for a, b in zip(first, first[1:], strict=False):
            if b > a:
                mine = scores[np.arange(a, b), path[a:b]].sum() - penalty * (path[a + 1 : b] != path[a : b - 1]).sum()
                assert mine == brute_path(scores[a:b], penalty)


def test_two_stretches_that_share_one_change():
    scores = np.array([[7, 0, -50], [0, 0, 0], [-50, 0, 7]])
    assert language.viterbi(scores, np.array([0, 3]), 12).tolist() in ([0, 0, 2], [0, 2, 2])
    rng = np.random.default_rng(8)
    for _ in range(200):
        scores = rng.integers(-9, 0, (6, 4))
        path = language.viterbi(scores, np.array([0, 6]), 12)
        assert scores[np.arange(6), path].sum() - 12 * (path[1:] != path[:-1]).sum() == brute_path(scores, 12)


def test_edges(spark):
    model = language.fit(table(spark, [(1, "the house", "en", ""), (2, "das haus", "de", "")]))
    out = language.identify(documents(spark, EDGE_TEXTS, extra=["lang_pred", "Score"]), model).collect()
    letters = [any(c.isalpha() for c in t or "") for t in EDGE_TEXTS]
    assert [r.lang_pred != "und" for r in sorted(out, key=lambda r: r.doc_id)] == letters
    assert all(0 <= r.score <= 1 for r in out)
    none = language.fit(table(spark, []))
    assert language.identify(documents(spark, ["abc"]), none).first().lang_pred == "und"
    assert language.identify(documents(spark, []), model).count() == 0
    long = "the house " * 100_000 + "das haus " * 100_000
    r = language.identify(documents(spark, [long]), model).first()
    assert [s.lang for s in r.lang_spans] == ["en", "de"] and r.lang_spans[0].end == 999_999


def test_held_out_accuracy(spark):
    from prefops.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language_id"](spark, sf_dir).collect()
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(langs) and len(held) > 250 and sum(held) >= 0.98 * len(held)
