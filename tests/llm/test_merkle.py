import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefops.llm import merkle
from tests.llm.common import EDGE_TEXTS, documents, random_texts

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        yield at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""
        at >>= 1


def brute(rows, claimed=lambda row: row):
    """(key, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for g in langs]
    trees = [climb([brute_leaf(r) for r in g]) for g in groups]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for at, row in enumerate(group):
            steps = [*path(tree, at), *path(top, k)]
            folded = brute_leaf(claimed(row))
            for right, sibling in steps:
                folded = h(sibling + folded if right else folded + sibling)
            out.append((row[0], tree[0][at], tree[-1][0], top[-1][0], "".join(s for _, s in steps), folded, folded == top[-1][0]))
    return out


def proofs(df, claimed=None, leaves=None):
    m = merkle.manifest(df, merkle.leaf_hash([F.col(c) for c in FIELDS]), "lang", "doc_id", claimed, whole=leaves is not None)
    return [tuple(r) for r in merkle.prove(m, None if leaves is None else leaves(m)).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed,n,bits", [(1, 1, 12), (3, 70, 3), (4, 129, 2), (5, 300, 5)])
def test_proofs_against_brute_force(spark, monkeypatch, seed, n, bits):
    """Small parts and blocks, so that trees span many; equal rows, null and repeated keys, groups of one row."""
    monkeypatch.setattr(merkle, "PART_BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 4)
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", None, "", "éa", "z" + str(seed)]
    rows = [(rng.choice([None, 5, *range(3 * n)]), "s", rng.choice(langs), rng.choice([None, 3]), rng.choice(["same", None, f"t{k}"])) for k in range(n)]
    rows += rows[: n // 5]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("at", F.lit("clash")).repartition(3)
    claimed = merkle.leaf_hash([F.col(c) if c != "n_chars" else F.col(c) + 1 for c in FIELDS])
    want = brute(rows, lambda r: (*r[:3], None if r[3] is None else r[3] + 1, r[4]))
    assert ordered(proofs(df, claimed)) == ordered(want)


def test_some_leaves(spark, monkeypatch):
    """A choice of leaves is proved with what these miss."""
    monkeypatch.setattr(merkle, "PART_BITS", 4)
    df = documents(spark, random_texts(7, 90)).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")).repartition(2)
    want = brute([tuple(r[c] for c in FIELDS) for r in df.collect()])
    got = proofs(df, leaves=lambda m: m.leaves.where("key in (0, 1, 2, 40, 77)"))
    assert ordered(got) == ordered([r for r in want if r[0] in (0, 1, 2, 40, 77)])
    assert proofs(df, leaves=lambda m: m.leaves.where("false")) == []


def test_edge_rows_and_nothing(spark):
    df = documents(spark, EDGE_TEXTS, extra=["hash", "group", "key", "part", "tree"])
    assert ordered(proofs(df)) == ordered(brute([tuple(r[c] for c in FIELDS) for r in df.collect()]))
    assert proofs(documents(spark, [])) == []


@given(st.integers(1, 200).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(0, n - 1), min_size=1))))
@settings(max_examples=200, deadline=None)
def test_missing_nodes_are_the_fewest(case):
    size, chosen = case
    at = np.array(sorted(chosen))
    levels = climb([h(str(i)) for i in range(size)])
    fetched = {c: levels[c[0]][c[1]] for c in merkle.missing(at, size)}
    assert merkle.Paths({i: levels[0][i] for i in chosen}, size, dict(fetched)).root == levels[-1][0]
    # None of them holds a chosen leaf, so none could be derived.
    assert all(i >> level != idx for level, idx in fetched for i in chosen)
    for gone in fetched:
        with pytest.raises(KeyError):
            merkle.Paths({i: levels[0][i] for i in chosen}, size, {c: v for c, v in fetched.items() if c != gone})
