import hashlib
import re

from prefops.llm import decontaminate
from tests.llm.common import EDGE_TEXTS, MIRRORED, documents, random_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    ws, hit, found = words(text), set(), set()
    for name, item in items:
        it = words(item)
        k = min(window, len(it))
        targets = {tuple(it[i : i + k]) for i in range(len(it) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1) if k else ():
            if tuple(ws[i : i + k]) in targets:
                hit |= set(range(i, i + k))
                found.add(name)
    return len(ws), len(hit), sorted(found)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id string, text string")


def test_against_brute_force(spark):
    texts = EDGE_TEXTS + random_texts(2, 150, vocabulary=3, longest=80)
    for window, n_items, longest, blocks in ((4, 12, 20, 1), (10, 6, 30, 1), (3, 30, 2, 1), (4, 12, 20, 5), (2, 40, 3, 3)):
        items = [(str(i), t) for i, t in enumerate(random_texts(window * 7 + n_items, n_items, vocabulary=3, longest=longest) + ["same text here", "", None])]
        size = sum(len((t or "").encode()) for _, t in items)
        out = decontaminate.decontaminate(documents(spark, texts).repartition(3), items_table(spark, items), window=window, block_bytes=size // blocks + 1)
        for r in out.collect():
            n, n_hit, found = brute(texts[r.doc_id], items, window)
            assert (r.n_words, r.n_hit, r["items"]) == (n, n_hit, found), (window, texts[r.doc_id])
            assert r.contaminated == (n_hit > 0) and r.kept == (n_hit <= 0.5 * n)
            if texts[r.doc_id] is None:
                assert r.clean_text is None
            else:
                cut = texts[r.doc_id]
                gone = [cut[s.start : s.end] for s in r.hit_spans]
                assert sum(len(words(g)) for g in gone) == n_hit
                for s in reversed(r.hit_spans):
                    cut = cut[: s.start] + cut[s.end :]
                assert cut == r.clean_text


def test_no_items_no_texts_clashing_names(spark):
    none = items_table(spark, [])
    out = decontaminate.decontaminate(documents(spark, ["a b", None], extra=["kept", "Items"]), none).collect()
    assert [(r.n_hit, r.kept, r["items"]) for r in out] == [(0, True, []), (0, True, [])]
    assert decontaminate.decontaminate(documents(spark, []), items_table(spark, [("1", "a b")])).count() == 0
    nameless = items_table(spark, [(None, "a b"), ("2", "a b"), ("2", "c")])
    assert decontaminate.decontaminate(documents(spark, ["x a b c"]), nameless).first()["items"] == ["", "2"]


def test_long_text(spark):
    passage = " ".join(f"q{i}" for i in range(15))
    text = ("filler words go on and on " * 50_000) + passage + (" more filler" * 50_000)
    r = decontaminate.decontaminate(documents(spark, [text]), items_table(spark, [("i", passage)])).first()
    assert (r.n_hit, r["items"], r.kept) == (15, ["i"], True)
    assert passage not in r.clean_text and len(r.clean_text) == len(text) - len(passage)


def test_given_tables(spark, sf_dir):
    from prefops.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = QUERIES["op5_decontaminate"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, n_hit, found = brute(docs[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.n_items) == (n, n_hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_words_that_mirror_each_other(spark):
    a, b = MIRRORED
    items = spark.createDataFrame([("x", a)], "item_id string, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(documents(spark, [a, b]), items).collect()}
    assert got == {0: 1, 1: 0}
