import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefops.llm import spelling
from tests.llm.common import EDGE_TEXTS, documents


def brute_words(rows, min_length=6, min_count=5):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if key is None else zlib.crc32(f"{key}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=5):
    out = {}
    for w in n:
        close = sorted((v for v in n if near(v, w)), key=lambda v: (-n[v], v))
        out[w] = (close[0] if close and n[close[0]] >= ratio * n[w] else None, len(close))
    rows = set()
    for w, (form, count) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n[w], count, None if form is None else n[form]))
    return rows


def words_frame(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def as_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@given(st.lists(st.text(alphabet="abé", min_size=6, max_size=9), min_size=2, max_size=30), st.sampled_from([(3, 2), (6, 2), (8, 3)]))
@settings(max_examples=200, deadline=None)
def test_words_at_one_edit_share_a_signature(words, how):
    sig = [set(row) for row in spelling.signatures(words, 3, *how).tolist()]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if near(a, b):
                assert sig[i] & sig[j]


@pytest.mark.parametrize("seed", range(4))
def test_variants_against_brute_force(spark, seed):
    """Few letters, so that near words, ties and chains of forms abound."""
    rng = random.Random(seed)
    n = {"".join(rng.choice("abéz"[: 2 + seed % 3]) for _ in range(rng.randint(6, 8))): 5 * 6 ** rng.randint(0, 5) for _ in range(250)}
    assert as_rows(spelling.spelling_variants(words_frame(spark, n))) == brute_variants(n)
    chain = {"a" * k: 5 * 5 ** (k - 6) for k in range(6, 18)}
    got = as_rows(spelling.spelling_variants(words_frame(spark, chain)))
    assert got == brute_variants(chain) and {r[2] for r in got} == {"a" * 17}


def test_short_words_and_other_limits(spark):
    n = {w: 3 + 40 * k for k, w in enumerate(("a", "b", "ab", "ba", "abc", "é", "xyz"))}
    assert as_rows(spelling.spelling_variants(words_frame(spark, n), min_length=1, min_count=1, ratio=2)) == brute_variants(n, ratio=2)


def test_counts_with_changed_words(spark):
    texts = EDGE_TEXTS + ["Straße ÀÉÎõü×÷ wording " * 200, "lengthen LENGTHEN Lengthen ÉCOLIER écolier " * 50, "x" * 100_000 + " tail"] * 3
    rows = list(enumerate(texts)) * 2 + [(None, "lengthen " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = {r.word: r.n for r in spelling.word_counts(df, change=spelling.planted_change).collect()}
    assert got == brute_words(rows)
    many = [(k, "planting borrowed letters everywhere") for k in range(3000)]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(many, "doc_id long, text string"), change=spelling.planted_change).collect()}
    assert got == brute_words(many) and sum(got.values()) < 4 * 3000


def test_counts_are_handed_on(spark, monkeypatch):
    rows = [(k, f"{'abcdefgh'[k % 8] * 7} common") for k in range(400)]
    monkeypatch.setattr(spelling, "MOST_WORDS", 3)
    assert {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()} == {**{c * 7: 50 for c in "abcdefgh"}, "common": 400}


def test_nothing(spark):
    assert spelling.word_counts(documents(spark, [])).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="two parts"):
        spelling.near_pairs(words_frame(spark, {"abcdef": 5}), parts=3, left_out=1)


def test_signatures_are_not_broadcast(spark, tmp_path, capsys):
    """A table of words that is small as a file has many times its rows as signatures."""
    words_frame(spark, {f"{'abcdefgh'[k % 8] * 3}{k:05d}": 5 + k for k in range(2000)}).write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    for df in (spelling.near_pairs(words), spelling.spelling_variants(words)):
        df.explain()
        assert "Broadcast" not in capsys.readouterr().out
