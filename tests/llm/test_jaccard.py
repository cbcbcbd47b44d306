import random
import re

import numpy as np
import pyarrow as pa
import pytest

from prefops.llm import components, jaccard
from prefops.llm import text as tx
from tests.llm.common import EDGE_TEXTS, MIRRORED, documents, random_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or {tuple(ws)}


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, families, copies, longest=120, vocabulary=2000):
    """Texts and copies of them with more or fewer changed words, around the limit."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(vocabulary)}"
    out = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(1, longest))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            other = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 20)):
                at = rng.randrange(len(other))
                kind = rng.randrange(3)
                other[at : at + (kind != 0)] = [word()] * (kind != 2)
                other = other or ["x"]
            out.append(" ".join(other))
            if rng.random() < 0.5:
                base = other
    rng.shuffle(out)
    return out


def check(spark, texts, percent=80, k=5):
    got = {r.doc_id: r for r in jaccard.jaccard_components(documents(spark, texts).repartition(4), percent=percent, shingle=k).collect()}
    assert len(got) == len(texts)
    for i, (n, root) in enumerate(brute(texts, k, percent)):
        assert (got[i].n_shingles, got[i].component_id) == (n, root), texts[i][:200]


def test_near_copies(spark):
    check(spark, near_copies(1, 120, 5) + EDGE_TEXTS)


def test_other_limits(spark):
    check(spark, near_copies(2, 60, 6, longest=40), percent=60, k=2)
    check(spark, random_texts(3, 150, vocabulary=3, longest=12), percent=70, k=1)


def test_large_groups_and_common_passages(spark):
    """One group of many near copies, and a passage that half of the texts share, so that shingles are frequent."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    base = [f"b{i}" for i in range(90)]
    texts = []
    for i in range(150):
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(90)] = f"c{rng.randrange(1000)}"
        texts.append(" ".join(other))
    for i in range(120):
        own = " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 9, 12, 30])))
        texts += [f"{own} {passage}", f"{passage} {own}"][: rng.randint(1, 2)]
    check(spark, texts + near_copies(6, 30, 3))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(percent):
    """Without Spark: every pair that links meets in a signature, whatever is frequent."""
    rng = np.random.default_rng(percent)
    lost = checked = 0
    for trial in range(600):
        n = int(rng.integers(1, [8, 40, 300][trial % 3]))
        universe = rng.integers(0, 2**63, 4 * n + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(trial % 2)
        a = np.unique(rng.choice(universe, n))
        b = np.unique(np.append(rng.choice(a, max(1, int(len(a) * rng.uniform(0.8, 1))), replace=False), rng.choice(universe, int(n * rng.uniform(0, 0.15)))))
        if not jaccard.similar(a, b, percent) or (len(a) == len(b) and (a == b).all()):
            continue
        checked += 1
        frequent = np.sort(rng.choice(universe, int(len(universe) * rng.choice([0, 0.3, 0.9, 1])), replace=False))
        sets = jaccard.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        sigs, of, info = jaccard.signatures(sets, frequent, percent)
        # One of both may give up any that it can spare, here those of the smallest number.
        for giver in (0, 1):
            kept = set(sigs[of == giver].tolist())
            for band in set((info[of == giver] >> 2 * jaccard.SIZE_BITS).tolist()):
                mine = (of == giver) & (info >> 2 * jaccard.SIZE_BITS == band)
                spare = int(info[mine][0] >> jaccard.SIZE_BITS & jaccard.SIZE_MASK)
                kept -= set(sorted(set(sigs[mine].tolist()))[:spare])
            met = kept & set(sigs[of == 1 - giver].tolist())
            needs = int(sets.sizes[giver]) * (100 - percent) // percent
            other = int(sets.sizes[1 - giver]) * (100 - percent) // percent
            lost += not met and needs <= other
        lost += not set(sigs[of == 0].tolist()) & set(sigs[of == 1].tolist())
    assert checked > 40 and lost == 0


def test_empty_table_null_and_repeated_keys(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jaccard.jaccard_components(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]


def test_long_texts_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = documents(spark, [long, long + " end", "x" + long[:3000]], extra=["id", "n", "sig", "root"])
    assert [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 2)]


def test_texts_found_by_a_join(spark):
    """Beyond the limit of the broadcast the same links are found."""
    texts = near_copies(9, 40, 4)
    df = documents(spark, texts)
    keys, _, frequent = jaccard.shingle_sets(df, "doc_id", "text")
    pairs, _ = jaccard.candidates(df, "text", frequent, 80, 5)
    found = [sorted(tuple(r) for r in jaccard.linked(pairs, keys, df, "doc_id", "text", 80, 5, most_keys=m).collect()) for m in (0, 10**6)]
    assert found[0] == found[1] and found[0]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}
    for p in pairs:
        for x in p:
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[x] == r for x, r in root.items() if x in got)
    assert set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def test_sketches_never_drop_a_link():
    rng = np.random.default_rng(8)
    dropped = 0
    for trial in range(300):
        n = int(rng.integers(1, [6, 60, 900][trial % 3]))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.append(rng.choice(a, max(1, int(len(a) * rng.uniform(0.6, 1))), replace=False), rng.integers(0, 2**64, int(n * rng.uniform(0, 0.4)), dtype=np.uint64)))
        sets = jaccard.Sets(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        x, y = jaccard.sketches(sets)
        may = jaccard.may_link(x, y, len(a) + len(b), 80)
        assert may or not jaccard.similar(a, b, 80)
        dropped += not may
    assert dropped > 50


def test_order_of_hashes_is_kept():
    texts = tx.texts_of(pa.array(["a b c d e f a b c d e", None, "x"]))
    sets = jaccard.sets_of(texts)
    assert sets.sizes.tolist() == [6, 0, 1]
    assert (np.diff(sets.hashes[:6].astype(object)) > 0).all()


def test_words_that_mirror_each_other(spark):
    a, b = MIRRORED
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(documents(spark, [a, b, a]).coalesce(1)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_near_copies_around_the_limit_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(400):
        mine = list(base)
        for at in rng.sample(range(150), rng.randint(2, 8)):
            mine[at] = f"n{i}x{at}"
        texts.append(" ".join(mine))
    # Two that are far from all others and near each other.
    mine = [w if i % 15 else f"m{i}" for i, w in enumerate(base)]
    texts += [" ".join(mine), " ".join([*mine[:-1], "end"])]
    want = brute(texts, 5, 80)
    compared = []
    written = jaccard.io.written

    def counted(df, name):
        out = written(df, name)
        if name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(jaccard.io, "written", counted)
    rows = jaccard.jaccard_components(documents(spark, texts).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == dict(enumerate(want))
    assert 50 < len({root for _, root in want}) < 350 and sum(compared) <= 8 * len(texts)
