import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from prefops.llm import bpe, simple8b, tokenfile
from prefops.llm import text as tx
from prefops.llm.queries import BPE_RANKS, BPE_TOKENIZER
from prefops.llm.secrets import encoding
from tests.llm.common import EDGE_TEXTS, MIRRORED, documents, random_texts

RANKS, JSON, PATTERN = public_tokenizers.path(BPE_RANKS), public_tokenizers.path(BPE_TOKENIZER), public_tokenizers.PATTERN
HARD = ["it's we'll 'S 's' ''s don't'd", "  two  spaces\n\n  tab\t x ", "<|endoftext|> as text", "123 456abc ½ Ⅷ ٣", "\x1c\x85  a b", "é'ré 'sé", " ", "\n'll"]
EDGES = EDGE_TEXTS + HARD
SPECIALS = ["a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|>  <|endoftext|><|endoftext|>x", "half <|endo", "ftext|> of one", "'<|endoftext|>s \n\n<|endoftext|>"]


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strevlmdLZ19 \n\t.,!é中\x1c\x85 😀")), max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_pretokens_are_the_matches(texts):
    found = tx.texts_of(pa.array(texts, pa.string()))
    cut = tx.pretokens(found)
    words = tx.spans_of(found.data, cut.starts, cut.ends)
    for i, t in enumerate(texts):
        assert [w.decode() for w in words[cut.first[i] : cut.first[i + 1]]] == regex.findall(PATTERN, t)


def encode(df, **more):
    return bpe.encode(df, RANKS, PATTERN, **more)


def test_ids_are_those_of_the_library_and_decode_again(spark):
    texts = EDGES + random_texts(1, 60) + [None, ""]
    enc = encoding(RANKS, PATTERN)
    ids = encode(documents(spark, texts, extra=["ids", "key", "block"]).repartition(5).persist())
    for r in bpe.decode(ids, RANKS, PATTERN).collect():
        want = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (list(r.ids), r.n_tokens) == (want, len(want))
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
        assert bytes(r.packed) == np.array(want, "<u4").tobytes()


def test_words_that_mirror_each_other(spark, tmp_path):
    """Sums over bytes can't tell such words apart."""
    texts = [*MIRRORED, MIRRORED[1] + " " + MIRRORED[0]]
    enc, t = encoding(RANKS, PATTERN), tokenfile.tokenizer(JSON)
    rows = bpe.decode(encode(documents(spark, texts).coalesce(1)), RANKS, PATTERN).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.decoded).decode()) for r in rows} == {i: (enc.encode_ordinary(x), x) for i, x in enumerate(texts)}
    tokenfile.write_tokens(documents(spark, texts).coalesce(1), str(tmp_path / "t"), JSON, 2)
    assert {r.key: list(r.ids) for r in tokenfile.read_tokens(spark, str(tmp_path / "t")).collect()} == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}


def test_words_with_the_same_hash(monkeypatch):
    monkeypatch.setattr(tx, "hash_spans", lambda data, starts, ends, fold=False: (ends - starts).astype(np.uint64))
    texts = random_texts(8, 6, vocabulary=40)
    found = tx.texts_of(pa.array(texts))
    cut = tx.pretokens(found)
    words = tx.spans_of(found.data, cut.starts, cut.ends)
    d = tx.distinct_words(found.data, cut)
    once = tx.spans_of(found.data, d.starts, d.ends)
    assert [once[c] for c in d.codes] == words and len(set(once)) == len(once)
    assert sorted(bpe.block_words(pa.array(texts))[0]) == sorted(once)
    ids, t = tokenfile.WordIds(JSON), tokenfile.tokenizer(JSON)
    for part in (texts[:3], texts[3:], texts):
        assert tokenfile.encoded(ids, pa.array(part), 2).values.tolist() == [i for x in part for i in [*t.encode(x, add_special_tokens=False).ids, 2]]


def test_blocks_with_equal_rows_long_texts_and_null_keys(spark):
    long = "and so it goes; " * 700_000
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, long), (2, long)], "doc_id long, text string").repartition(1)
    got = encode(df.persist()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 2), (1, 2)] + [(2, len(encoding(RANKS, PATTERN).encode_ordinary(long)))] * 2
    same = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert [tuple(r.ids) for r in encode(same.union(same)).collect()] == [tuple(encoding(RANKS, PATTERN).encode_ordinary("x y z"))] * 2


def test_empty_table_and_unknown_ids(spark):
    assert encode(documents(spark, [])).count() == 0
    assert encode(documents(spark, [None])).first().ids == []
    df = spark.createDataFrame([([64, None, 99_999_999, -5],), (None,), ([],)], "ids array<int>")
    rows = bpe.decode(df, RANKS, PATTERN).collect()
    first = encoding(RANKS, PATTERN).decode_single_token_bytes(64) + bpe.UNKNOWN * 3
    assert [None if r.decoded is None else bytes(r.decoded) for r in rows] == [first, None, b""]


def test_given_tables(spark, sf_dir):
    from prefops.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    enc = encoding(RANKS, PATTERN)
    rows = QUERIES["op4_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_simple8b_round_trip(values, times):
    numbers = np.array(values * (1 + times * (len(values) > 100)), np.uint64)
    coded = simple8b.encode(numbers)
    assert (simple8b.decode(coded) == numbers).all() and len(simple8b.decode(coded)) == len(numbers)


def test_simple8b_blocks_and_sizes():
    ones = simple8b.encode(np.ones(10_000, np.uint64))
    assert len(ones.words) == 2 * 69 + 31 and ones.offsets.tolist() == [0, 69, 138]
    big = np.array([2**64 - 1, 5, 2**60, 2**60 - 1], np.uint64)
    assert simple8b.encode(big).escaped.tolist() == [2**64 - 1, 2**60]


def brute_tokens(rows, end_id=2):
    t = tokenfile.tokenizer(JSON)
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((key, start, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("files", [1, 3, 16])
def test_token_files(spark, tmp_path, files):
    texts = EDGES + SPECIALS + random_texts(4, 50)
    rows = [(3 * i - 40, t) for i, t in enumerate(texts)] + [(None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokenfile.write_tokens(df, str(tmp_path / "t"), JSON, 2, files=files)
    want = brute_tokens(rows)
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [(r.key, r.start, list(r.ids)) for r in got] == want
    digests = {(r.key, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_digests(spark, str(tmp_path / "t")).collect()}
    assert digests == {(k, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, s, i in want}


def test_token_files_of_long_texts_same_keys_and_nothing(spark, tmp_path):
    long = "on and on " * 150_000
    df = spark.createDataFrame([(5, long), (5, "b"), (5, "b"), (1, "")], "doc_id long, text string")
    tokenfile.write_tokens(df, str(tmp_path / "a"), JSON, 2)
    got = sorted(tokenfile.token_digests(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [1, 5, 5, 5] and [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got[:-1])]))
    tokenfile.write_tokens(documents(spark, []), str(tmp_path / "b"), JSON, 2)
    assert tokenfile.token_digests(spark, str(tmp_path / "b")).count() == 0


def test_words_are_forgotten_and_found_again():
    ids = tokenfile.WordIds(JSON, most=50)
    t = tokenfile.tokenizer(JSON)
    for seed in range(20):
        texts = random_texts(seed, 5, vocabulary=40)
        runs = tokenfile.encoded(ids, pa.array(texts), 2)
        flat = [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
        assert runs.values.tolist() == flat
    assert len(ids.hashes) <= 200


def test_given_token_files(spark, sf_dir):
    from prefops.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {(k, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, s, i in brute_tokens(rows)}
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, sf_dir).collect()} == want
