import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefops.llm import treebpe
from prefops.llm.queries import QUERIES, WORD_TOKENIZER
from tests.llm.common import EDGE_TEXTS, documents, random_texts

PATH = public_tokenizers.path(WORD_TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
BPE = treebpe.WordBpe(PATH)
PARTS = ["a", "the", "ing", "'", "'s", "s", "re", "'ll", " ", "  ", "\n", "é", "é", "̀", "İ", "Σ", "ς", "ﬁ", "Å", "中", "文", "1", "23", "½", "!", "=", "\x85", "\x1c", "ß", "🙂", "</w>", "<|endoftext|>"]
HARD = ["a<|endoftext|>́b", "<|startoftext|><|startoftext|>", "IT'S WE'LL ''s !'s", "ΑΣ ΑΣΑ", "é" * 50, "한국어" * 20]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def by_tree(text, size):
    ids, run = [], []
    for special, piece, goes_on in treebpe._segments(BPE, text, size):
        if special is not None:
            ids.append(special)
            continue
        run.append(BPE.part(piece, goes_on))
        if not goes_on:
            ids += BPE.tree(run).ids.tolist()
            run = []
    return ids


@given(st.lists(st.sampled_from(PARTS), max_size=80).map("".join), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_tree_gives_the_ids_of_the_library(text, size):
    assert BPE.short(text) == library(text) == by_tree(text, size)


@pytest.mark.parametrize("seed", range(25))
def test_long_words_and_windows(seed):
    """Segments much longer than the first window: words without a blank, repeats, runs of signs with contractions."""
    rng = random.Random(seed)
    alphabet = [PARTS, ["a", "b", "c"], ["ab"], ["=", "'s", "="], ["中", "文", "字"], ["x", "y1", "é"]][seed % 6]
    text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1000, 4000)))
    assert by_tree(text, rng.choice([97, 128, 300, 1000])) == library(text)


def test_every_character_below_the_marks():
    text = "".join(f"a{chr(c)}b {chr(c)}! " for c in range(treebpe.FIRST_MARK))
    assert BPE.short(text) == library(text)


def test_rows_of_all_kinds(spark):
    texts = EDGE_TEXTS + HARD + random_texts(3, 20) + ["word without end" * 900, "nospace" * 3000, "中文" * 2500]
    df = documents(spark, texts, extra=["ids", "row", "key", "seq"])
    nameless = documents(spark, ["no key " * 300], extra=["ids", "row", "key", "seq"]).withColumn("doc_id", F.lit(None).cast("long"))
    df = df.union(df.where("doc_id >= 40")).union(nameless)
    rows = treebpe.decode(treebpe.encode(df.repartition(3).persist(), PATH, segment=1000), PATH).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, list(r.ids), r.decoded, bytes(r.packed)) for r in rows)
    want = []
    for key, text in [*enumerate(texts), *((k, texts[k]) for k in range(40, len(texts))), (-1, "no key " * 300)]:
        ids = library(text)
        want.append((key, len(ids), ids, LIBRARY.decode(ids, skip_special_tokens=False), np.array(ids, "<u4").tobytes()))
    assert got == sorted(want)


def test_nothing_and_unknown_ids(spark):
    assert treebpe.encode(documents(spark, []), PATH).count() == 0
    df = spark.createDataFrame([([320, None, 9_999_999, -4, 49407],), (None,), ([],)], "ids array<int>")
    rows = treebpe.decode(df, PATH).collect()
    assert [r.decoded for r in rows] == ["a</w> <|endoftext|>", None, ""]


def test_given_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_tree_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
