import re
from collections import Counter

import numpy as np
import pytest

from prefops.llm import quality
from tests.llm.common import EDGE_TEXTS, MIRRORED, documents, random_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def brute_llr(texts, trusted, gram, buckets):
    def bucket(b):
        key = 0
        for x in b:
            key = (key * 257 + x) % 2**64
        return (key * (0x9E3779B97F4A7C15 | 1) % 2**64) >> (64 - (buckets - 1).bit_length())

    def grams(t):
        b = (t or "").encode()
        return [bucket(b[i : i + gram]) for i in range(len(b) - gram + 1)]

    p = np.bincount([g for t in trusted for g in grams(t)] or [0], minlength=buckets) + 1.0
    q = np.bincount([g for t in texts for g in grams(t)] or [0], minlength=buckets) + 1.0
    ratio = np.rint((np.log(p / p.sum()) - np.log(q / q.sum())) * 1e6)
    return [sum(ratio[g] for g in grams(t)) / (max(1, len(grams(t))) * 1e6) for t in texts]


def test_against_brute_force(spark):
    texts = EDGE_TEXTS + random_texts(1, 60, vocabulary=4) + ["one line\n" * 30 + "| a | b |"]
    trusted = texts[20:50]
    df = documents(spark, texts).repartition(5)
    got = {r.doc_id: r for r in quality.score_quality(df, documents(spark, trusted), gram=3, buckets=1 << 10, threshold=-0.01).collect()}
    llr = brute_llr(texts, trusted, 3, 1 << 10)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(t)
        assert r.llr == pytest.approx(llr[i], abs=1e-12)
        assert r.kept == (not r.base_failed and r.llr >= -0.01)
    assert {r.kept for r in got.values()} == {True, False}
    assert got[7].llr == got[8].llr


def test_long_text_and_repeats(spark):
    text = "".join(f"word{i % 997} and so on\n" for i in range(200_000))
    df = documents(spark, [text, text])
    rows = quality.score_quality(df, df, keep=["doc_id"]).collect()
    assert [(r.n_words, r.n_repeat_words) for r in rows] == [(800_000, 800_000)] * 2
    assert not any(r.kept for r in rows)


def test_empty_tables_and_clashing_names(spark):
    none = documents(spark, [])
    some = documents(spark, ["a b c " * 10], extra=["kept", "LLR"])
    assert quality.score_quality(none, none).count() == 0
    out = quality.score_quality(some, none)
    assert out.columns.count("kept") == 1 and "LLR" not in out.columns
    assert out.first().llr == 0.0


def test_given_tables(spark, sf_dir):
    """Every document of the table, word counts and rules as by plain Python, junk out and prose in."""
    from prefops.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(docs[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    passed = [r for r in rows if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in passed if labels[r.doc_id] == 1]
    bad = [r.kept for r in passed if labels[r.doc_id] == 0]
    assert all(good) and sum(bad) <= 0.1 * max(1, len(bad))


def test_lines_that_mirror_each_other(spark):
    text = "\n".join([*MIRRORED, MIRRORED[0]])
    assert quality.score_quality(documents(spark, [text]), documents(spark, ["a b c"])).first().n_dup_lines == 1
