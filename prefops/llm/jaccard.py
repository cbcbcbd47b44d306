"""Exact Jaccard join of word shingles by partitioning the universe of shingles.

A text's set is that of the hashes of its shingles. Sets whose sizes lie in the
same band have the universe cut into the same segments of hash range. Two sets
that link differ in at most H shingles, H a quarter of either size, so that among
any H + 1 segments at least one holds the same shingles in both. A set therefore
only indexes a subset of its segments: the first H + 1 that are worth it.

What a segment costs is known from counts over the whole corpus: an empty one,
or one of nothing but frequent shingles, is shared by sets that have nothing
else in common, and is passed over. Both sets of a pair pass over the same
shared segments, so this loses no pair. A set that runs short of good segments
indexes all it has, each with its one-deletion neighbourhood (the segment without
one of its shingles, which also meets segments that differ by one); if that
isn't enough either, it indexes its first shingles one by one. Sets near those
limits index these too, since their partners may be beyond.

Counts from single tasks miss what is frequent overall but not in a task. So a set
indexes half as many segments again, and when it is known how many sets share
each signature, it gives up its most frequent ones, down to H + 1. A pair is
compared where one of both still stands by the signature that they share.

Sets that meet in a signature are compared by sketches first, some bits per
shingle that bound from below how many shingles they differ in, and what may
still link is compared exactly. Signatures that many sets
share are not expanded: every set is compared with the first one, and linked sets
are merged into components. Sets of different components that still share a
signature are told apart by what they don't have in common with a centre of its
sets, their rest. Two sets differ in as many shingles as their rests do, so that
either both link with the set that is next to the centre, or they link with each
other only if their rests have some shingles in common, the more the larger they
are. Near copies of one text have small rests that hardly meet, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.components import connected_components
from prefops.llm.frames import MOST_KEYS, bounded_batches, map_texts, quoted, rows_of_keys
from prefops.sources import io

SHINGLE = 5
#: The similarity from which sets link, as a percentage.
PERCENT = 80
#: A band's largest size is four times its smallest.
BAND = 4
#: Shingles of more than this share of the sets, and of no fewer than LEAST_FREQUENT, are frequent.
FREQUENT_SHARE = 1 / 2000
LEAST_FREQUENT = 32
#: A task tells of the shingles that so many of its sets hold.
LOCAL_FREQUENT = 3
#: A signature that no more sets share isn't given up.
CHEAP = 8
#: So many sets that share a signature are compared with each other at once; of more, each with the first.
SMALL = 2

_SALT = np.uint64(0xA0761D6478BD642F)
_SINGLE = np.uint64(0xE7037ED1A0B428DB)


class Sets:
    """Shingle hashes of some texts, sorted within each: set i is hashes[first[i]:first[i + 1]]."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first
        self.sizes = np.diff(first)
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(tx.mix(hashes ^ _SALT), out=total[1:])
        #: One number per set that depends on nothing but its shingles.
        self.ids = tx.mix(total[first[1:]] - total[first[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def chosen(self, which: np.ndarray) -> "Sets":
        runs = tx.take_runs(tx.Runs(self.hashes, self.first[1:]), which)
        return Sets(runs.values, np.append(0, runs.ends))


def sets_of(texts: tx.Texts, shingle: int = SHINGLE) -> Sets:
    """The sets of shingles of some texts; a text of fewer words has its whole sequence as the only one."""
    words = tx.words_of(texts, tx.NOT_SPACE)
    hashes = tx.hash_spans(texts.data, words.starts, words.ends, fold=True)
    found, at = tx.windows(hashes, words.first, shingle)
    owner = np.searchsorted(words.first, at, side="right") - 1 if len(at) else at
    n = len(words.first) - 1
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(shingle - 1):
            has = counts[short] > k
            whole[has] = tx.mix(whole[has] * np.uint64(tx.BASE) + hashes[words.first[short[has]] + k])
        found, owner = np.append(found, tx.mix(whole + counts[short].astype(np.uint64))), np.append(owner, short)
    order = np.argsort(found)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return Sets(found[new], np.searchsorted(owner[new], np.arange(n + 1)))


def sketches(sets: Sets) -> list[bytes]:
    """For each set, whether the number of its shingles is odd in each of two to four times as many ranges of hash."""
    bits = np.where(sets.sizes > 0, 2 << np.ceil(np.log2(np.maximum(sets.sizes, 4))).astype(np.int64), 8)
    base = np.append(0, np.cumsum(bits))
    shift = (64 - np.round(np.log2(bits)).astype(np.int64)).astype(np.uint64)
    place = (sets.hashes >> np.repeat(shift, sets.sizes)).astype(np.int64) + np.repeat(base[:-1], sets.sizes)
    raw = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    at = (base // 8).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


def may_link(x: bytes, y: bytes, total: int, percent: int) -> bool:
    """Whether the sketches of two sets of `total` shingles together allow that they link.

    A range in which one number is odd and the other even holds a shingle that
    only one set has. Ranges of the finer sketch are put together for the other.
    """
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    if len(a) < len(b):
        a, b = b, a
    a = a.reshape(len(b), -1).sum(axis=1) & 1
    return int(np.count_nonzero(a != b)) * (100 + percent) <= total * (100 - percent)


def shares(percent: int) -> tuple[int, int]:
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    return percent, 100 - percent


def budget(sizes: np.ndarray, percent: int) -> np.ndarray:
    """One more than the most shingles by which a set and one that it links with differ.

    With similarity t the other has at most size / t shingles, and two sets of
    together n differ in at most n (1 - t) / (1 + t): size (1 - t) / t.
    """
    p, q = shares(percent)
    return sizes * q // p + 1


def band_edges(largest: int) -> np.ndarray:
    edges = [1]
    while edges[-1] <= 2 * largest:
        edges.append(edges[-1] * BAND)
    return np.array(edges, np.int64)


def signatures(sets: Sets, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of all sets, the set of each, and what else matters: how many the set can spare there, and its size.

    The last is the band, the number of signatures in that band that the set can
    give up, and the size, packed into one number.
    """
    p, _ = shares(percent)
    sizes = sets.sizes
    edges = band_edges(int(sizes.max(initial=1)))
    band = np.searchsorted(edges, sizes, side="right") - 1
    is_frequent = np.zeros(len(sets.hashes), bool)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, sets.hashes), len(frequent) - 1)
        is_frequent = frequent[place] == sets.hashes
    # A set of fewer shingles only links with an equal one.
    able = budget(sizes, percent) > 1
    out, of, infos = [], [], []
    for step in (0, 1):
        # A set that may link with one of the next band also takes part in that band.
        role = band + step
        mine = able if step == 0 else able & (100 * sizes >= p * edges[np.minimum(role, len(edges) - 1)])
        which = np.flatnonzero(mine)
        if len(which):
            sigs, owner, spare = _band_signatures(sets.chosen(which), role[which], edges, is_frequent[_rows(sets, which)], percent)
            out.append(sigs)
            of.append(which[owner])
            infos.append(((role[which] << SIZE_BITS | spare) << SIZE_BITS | sizes[which])[owner])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of), np.concatenate(infos)


#: Bits of a size; a set of more shingles (134 million) would be an error.
SIZE_BITS = 27
SIZE_MASK = (1 << SIZE_BITS) - 1


def _rows(sets: Sets, which: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(sets.sizes), bool)
    mask[which] = True
    return np.repeat(mask, sets.sizes)


def _band_signatures(sets: Sets, role: np.ndarray, edges: np.ndarray, is_frequent: np.ndarray, percent: int):
    p, q = shares(percent)
    sizes, first, hashes = sets.sizes, sets.first, sets.hashes
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    # Twice as many segments as the largest set of the band has shingles; hashes are sorted, so segments are runs.
    segments = 2 * edges[role + 1]
    segment = ((hashes >> np.uint64(32)) * segments[owner].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(hashes), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(hashes))
    mixed = tx.mix(hashes ^ _SALT)
    total = np.append(np.uint64(0), np.cumsum(mixed))
    rare = np.append(0, np.cumsum(~is_frequent))
    content, good = total[stop] - total[at], rare[stop] - rare[at]
    run_owner, place = owner[at], tx.mix(segment[at] + (segments[owner[at]].astype(np.uint64) << np.uint64(32)))
    usable = good > 0
    rank = np.cumsum(usable)
    run_first = np.searchsorted(run_owner, np.arange(n + 1))
    before = np.append(0, rank)[run_first[:-1]]
    count = np.append(0, rank)[run_first[1:]] - before
    need = budget(sizes, percent)
    partner = sizes * 100 // p  # the largest set it may link with
    # Partners of a set that runs short have fewer than these.
    differ = sizes * q // p + 1
    short = count < budget(partner, percent) + differ
    value = np.append(0, np.cumsum(np.where(usable, np.where(good >= 2, 2, 1), 0)))
    worth = value[run_first[1:]] - value[run_first[:-1]]
    poor = short & (worth < budget(partner, percent) + 2 * differ)

    more = need + need // 2 + 1
    take = usable & (short[run_owner] | (rank - before[run_owner] <= more[run_owner]))
    spare = np.where(short, 0, np.minimum(count, more) - need)
    sigs, of = [tx.mix(content[take] + place[take])], [run_owner[take]]
    # One-deletion neighbourhoods of segments that are left with a good shingle.
    wide = usable & (good >= 2) & short[run_owner]
    if wide.any():
        run = np.repeat(np.arange(len(at)), stop - at)
        item = wide[run]
        # Segments of the same shingles are equal, so a neighbourhood is that of the shingles.
        sigs.append(tx.mix(content[run[item]] - mixed[item] + place[run[item]]))
        of.append(owner[item])
    if poor.any():
        # In one order for all sets: rare shingles first, then by hash.
        rare_before = rare[:-1] - rare[first[owner]]
        in_set = np.arange(len(hashes)) - first[owner]
        rares = (rare[first[1:]] - rare[first[:-1]])[owner]
        place_in_order = np.where(is_frequent, rares + in_set - rare_before, rare_before)
        prefix = sizes - (p * sizes + 99) // 100 + 1
        item = poor[owner] & (place_in_order < prefix[owner])
        sigs.append(tx.mix(hashes[item] ^ _SINGLE))
        of.append(owner[item])
    return np.concatenate(sigs), np.concatenate(of), spare


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingle_sets(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Each row's key, set size, set id and sketch; frequent shingles with their counts; the frequent ones, sorted."""
    bounded_batches(df.sparkSession)

    def scan(batches):
        seen: list[np.ndarray] = []
        held = 0
        for batch in batches:
            column = batch.column(1)
            for lo, hi in tx.pieces(column):
                sets = sets_of(tx.texts_of(column.slice(lo, hi - lo)), shingle)
                rows = batch.column(0).slice(lo, hi - lo)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), rows, pa.array(sets.sizes), pa.array(sets.ids), pa.array(sketches(sets), pa.binary())], _SET_COLUMNS)
                once = np.unique(sets.ids, return_index=True)[1]
                seen.append(sets.chosen(once).hashes)
                held += len(seen[-1])
                if held > MOST_HELD:
                    yield _reports(seen, rows.type)
                    seen, held = [], 0
        if seen:
            yield _reports(seen, rows.type)
        tx.release()

    kind = df.schema[key].dataType.simpleString()
    both = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string")).mapInArrow(scan, f"kind byte, key {kind}, n long, id long, sketch binary")
    table = io.written(both, "sets")
    keys = table.where("kind = 0").select("key", "n", "id", "sketch")
    least = max(LEAST_FREQUENT, int(keys.count() * FREQUENT_SHARE))
    # The counts of all shingles add up to all sizes, so no more than 1 / FREQUENT_SHARE times the mean size pass.
    counts = table.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    frequent = counts.select("id").toArrow()["id"].to_numpy().astype(np.int64).view(np.uint64)
    return keys, counts, np.sort(frequent)


_SET_COLUMNS = ["kind", "key", "n", "id", "sketch"]
#: A task counts so many shingles (64 MB) together.
MOST_HELD = 8_000_000


def _reports(seen: list[np.ndarray], key_type) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(seen), return_counts=True)
    often = counts >= LOCAL_FREQUENT
    n = int(often.sum())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), pa.nulls(n, key_type), pa.array(counts[often]), pa.array(values[often].view(np.int64)), pa.nulls(n, pa.binary())], _SET_COLUMNS)


def candidates(df: DataFrame, text: str, frequent: np.ndarray, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets (a, b) to compare, and the sets (sig, id, info) of every signature that more than SMALL share."""
    known = df.sparkSession.sparkContext.broadcast(frequent)

    def index(batches):
        done: set[int] = set()
        for batch in batches:
            for lo, hi in tx.pieces(batch.column(0)):
                sets = sets_of(tx.texts_of(batch.column(0).slice(lo, hi - lo)), shingle)
                once = np.unique(sets.ids, return_index=True)[1]
                fresh = once[[i not in done for i in sets.ids[once].tolist()]]
                done.update(sets.ids[fresh].tolist())
                if len(done) > MOST_IDS:
                    done.clear()
                chosen = sets.chosen(fresh)
                sigs, of, infos = signatures(chosen, known.value, percent)
                ids = chosen.ids[of]
                for at in range(0, len(sigs), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(sigs[s].view(np.int64)), pa.array(ids[s]), pa.array(infos[s])], ["sig", "id", "info"])
        tx.release()

    rows = df.select(F.col(quoted(text)).cast("string")).mapInArrow(index, "sig long, id long, info long")
    sorted_rows = rows.repartition("sig").sortWithinPartitions("sig", "id")
    met = io.written(sorted_rows.mapInArrow(lambda b: _meet(b, percent), "kind byte, a long, b long, info long"), "met")
    return met.where("kind = 0").select("a", "b").distinct(), met.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("id"), "info")


#: A task remembers so many sets that it has indexed already.
MOST_IDS = 1_000_000


def _meet(batches, percent: int):
    """Pairs and shared signatures of rows sorted by (sig, id).

    Only the last signature of a batch is carried on, with its first SMALL + 1
    sets at most, so that memory doesn't grow with a signature's sets.
    """
    sig = None
    held: list[tuple[int, int, int]] = []  # (id, size, info) of the sets of the signature that is open
    large = False

    def linkable(a, b):
        return a[0] != b[0] and 100 * min(a[1], b[1]) >= percent * max(a[1], b[1])

    def close(pairs):
        if not large:
            pairs += [(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(held) for b in held[i + 1 :] if linkable(a, b)]

    for batch in batches:
        sigs, ids, infos = (batch.column(i).to_numpy() for i in range(3))
        pairs: list[tuple[int, int]] = []
        members: list[tuple[int, int, int]] = []
        n = len(sigs)
        if not n:
            continue
        same = np.zeros(n + 1, bool)
        same[1:-1] = sigs[1:] == sigs[:-1]
        # Signatures of one set, but for the first and last of the batch, are passed by at once.
        shared = same[:-1] | same[1:]
        shared[0] = shared[-1] = True
        for s, i, info in zip(sigs[shared].tolist(), ids[shared].tolist(), infos[shared].tolist(), strict=True):
            size = info & SIZE_MASK
            if s != sig:
                close(pairs)
                sig, held, large = s, [], False
            if held and held[-1][0] == i:
                continue
            if large:
                held[1:] = [(i, size, info)]
                members.append((s, i, info))
                if linkable(held[0], held[1]):
                    pairs.append((held[0][0], i))
                continue
            held.append((i, size, info))
            if len(held) > SMALL:
                large = True
                members += [(s, x, m) for x, _, m in held]
                pairs += [(held[0][0], x[0]) for x in held[1:] if linkable(held[0], x)]
        different = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        yield _met(0, different)
        if members:
            yield _met(1, np.array(members, np.int64))
    pairs = []
    close(pairs)
    if pairs:
        yield _met(0, np.array(pairs, np.int64))


def _met(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(2)), pa.array(np.ascontiguousarray(rows[:, 2]) if kind else np.zeros(len(rows), np.int64))], ["kind", "a", "b", "info"])


def whole_sets(wanted: DataFrame, df: DataFrame, key: str, text: str, shingle: int, most_keys: int = MOST_KEYS) -> DataFrame:
    """The sets (id, hashes) of the rows with a wanted key, a set as often as it has rows.

    Rows with the same key may have other sets, that nobody asks for.
    """
    texts = rows_of_keys(df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text")), "key", wanted, most=most_keys)

    def make(column: pa.Array) -> list[pa.Array]:
        sets = sets_of(tx.texts_of(column), shingle)
        raw, first = sets.hashes.tobytes(), sets.first.tolist()
        return [pa.array(sets.ids), pa.array([raw[8 * a : 8 * b] for a, b in zip(first, first[1:], strict=False)], pa.binary())]

    return io.written(map_texts(texts, "text", "id long, hashes binary", make, keep=[]), "compared")


def linked(pairs: DataFrame, keys: DataFrame, df: DataFrame, key: str, text: str, percent: int, shingle: int, most_keys: int = MOST_KEYS) -> DataFrame:
    """The pairs (a, b) whose sets link: by their sketches first, then from the whole sets.

    One text of each set that is in a pair is read again; no other text or set is
    moved, up to `most_keys` of them (see `rows_of_keys`).
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # Equal ids have equal sizes and sketches.
    one = keys.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    one = io.written(one, "wanted")
    sketched = pairs.join(one.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    sketched = sketched.join(one.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    def likely(batches):
        for batch in batches:
            total = batch.column(2).to_numpy()
            x, y = batch.column(3), batch.column(4)
            good = [may_link(x[i].as_py(), y[i].as_py(), int(total[i]), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    pairs = io.written(sketched.select("a", "b", F.col("na") + F.col("nb"), "sa", "sb").mapInArrow(likely, "a long, b long"), "likely")
    one = one.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    sets = whole_sets(one.select("key"), df, key, text, shingle, most_keys)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")

    def compare(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def size_edges(percent: int) -> list[int]:
    """The smallest sizes of classes of size; sets that link are of the same class or of neighbouring ones."""
    edges = [1]
    while edges[-1] < SIZE_MASK:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


REST = "center long, class int, id long, n long, kept boolean, n_center long, score long, rest binary"


def _votes(batches):
    """Of rows (center, class, hashes, hashes of the central set) the shingles that only one of both has, and a null for the set.

    Sets that have little in common with the central one have no vote.
    """
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            rest = np.setxor1d(x, y, assume_unique=True).view(np.int64)
            out.append(rest if 2 * len(rest) <= len(y) else None)
        voters = np.flatnonzero([r is not None for r in out])
        if not len(voters):
            continue
        found = [out[i] for i in voters.tolist()]
        row = np.append(np.repeat(voters, [len(r) for r in found]), voters)
        shingles = pa.concat_arrays([pa.array(np.concatenate(found)), pa.nulls(len(voters), pa.int64())])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), shingles], ["center", "class", "shingle"])


def _rests(batches, frequent: np.ndarray, percent: int):
    """Rows (center, class, id, n, kept, hashes, hashes of the central set, shingles that most sets change in it) with their rests.

    The rest is the shingles that only one of the set and the centre has; the centre
    is the central set with what most change. The score is (100 + percent) times
    their number less (100 - percent) times n: two sets link if (100 + percent)
    times the shingles that both rests have is no less than half the sum of their
    scores. Shingles that few sets have come first, as far as that is known: those
    of the set itself before those that it lacks, and frequent ones after others.
    """
    p, q = shares(percent)
    for batch in batches:
        sizes, centers, scores, rests = batch.column(3).to_numpy(), [], [], []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (5, 6))
            if batch.column(7)[i].is_valid:
                y = np.setxor1d(y, batch.column(7)[i].values.to_numpy().view(np.uint64), assume_unique=True)
            rest = np.setxor1d(x, y, assume_unique=True)
            lacks = np.isin(rest, y)
            often = np.isin(rest, frequent) if len(frequent) else lacks
            rests.append(rest[np.lexsort((rest, often, lacks))].tobytes())
            centers.append(len(y))
            scores.append((100 + p) * len(rest) - q * int(sizes[i]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(centers, pa.int64()), pa.array(scores, pa.int64()), pa.array(rests, pa.binary())], [f.split()[0] for f in REST.split(", ")])


def _rest_index(batches, percent: int):
    """Rows of REST, with the component and the classes of score in the group, by the shingles of their rests that a linked set must meet one of.

    With a set of another class the rest has at least
    `common` shingles in common, so that both have one of them among the first
    len(rest) - common + 1.
    """
    p, q = shares(percent)
    names = ["key", "mine", "other", "id", "root", "n", "size", "kept"]
    for batch in batches:
        out, held = [], 0
        for center, size, i, n, kept, n_center, score, rest, width, mine, root, other in zip(*(batch.column(k).to_pylist() for k in range(12)), strict=True):
            rest = np.frombuffer(rest, np.uint64)
            if not len(rest):
                continue  # the centre itself: what it links with is known
            other = np.array(other, np.int64)
            low = other * width - q * n_center  # the least of all scores is that of the centre
            common = np.maximum(1, -(-(score + low) // (2 * (100 + p))))
            longest = (low + width - 1 + q * (100 * n // p)) // (100 + p)
            # Where no sum of scores is above 0 all link with the set next to the centre.
            able = (common <= np.minimum(len(rest), longest)) & (score + low + width - 1 > 0)
            other, take = other[able], len(rest) - common[able] + 1
            at = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
            place = tx.mix(tx.mix(np.array([center], np.int64).view(np.uint64)) + np.uint64(size))
            rows = len(at)
            out.append((tx.mix(rest[at] ^ place).view(np.int64), np.full(rows, mine), np.repeat(other, take), *(np.full(rows, x) for x in (i, root, n, size, kept))))
            held += rows
            if held > 1 << 18:
                yield _indexed(out, names)
                out, held = [], 0
        if out:
            yield _indexed(out, names)


def _indexed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names)


def rests(crowd: DataFrame, keys: DataFrame, df: DataFrame, key: str, text: str, frequent: np.ndarray, percent: int, shingle: int) -> DataFrame:
    """The rests (REST) of the sets (sig, id, n, kept) of crowded signatures, towards a centre of each signature and class of size.

    The centre is a set that is in the most crowded signatures, with the changes
    that most of the sets near it share; signatures of the same such set are one
    group. A set is in the groups of its own class and of the next.
    """
    spark = df.sparkSession
    edges = ", ".join(map(str, size_edges(percent)))
    sets_of_sig = crowd.groupBy("sig").agg(F.count("*").alias("c"))
    often = crowd.join(sets_of_sig, "sig").groupBy("id").agg(F.sum(F.col("c").cast("decimal(19,0)") * F.col("c")).alias("often"))
    sized = crowd.join(often, "id").withColumn("own", F.expr(f"size(filter(array({edges}), x -> x <= n))"))
    sized = sized.select("sig", "id", "n", "kept", "often", F.posexplode(F.array("own", F.col("own") + 1)).alias("next", "class"))
    central = sized.groupBy("sig", "class").agg(F.max(F.struct("often", "id")).alias("best"), F.count("*").alias("sets"), F.max("kept").alias("some"), F.min("next").alias("next")).where("sets > 1 and some and next = 0")
    grouped = sized.join(central, ["sig", "class"]).groupBy(F.col("best.id").alias("center"), "class", "id").agg(F.max("n").alias("n"), F.max("kept").alias("kept"))
    grouped = io.written(grouped, "grouped")
    wanted = keys.join(grouped.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("key").alias("key"))
    sets = whole_sets(wanted.select("key"), df, key, text, shingle).dropDuplicates(["id"])
    centers = sets.select(F.col("id").alias("center"), F.col("hashes").alias("central"))
    both = grouped.join(sets, "id").join(centers, "center")
    group = ["center", "class"]
    votes = both.select(*group, "hashes", "central").mapInArrow(_votes, "center long, class int, shingle long")
    votes = io.written(votes.groupBy(*group, "shingle").agg(F.count("*").alias("votes")), "votes")
    voters = votes.where("shingle is null").select(*group, F.col("votes").alias("voters"))
    changed = votes.where("shingle is not null").join(voters, group).where("2 * votes > voters").groupBy(*group).agg(F.collect_list("shingle").alias("changed"))
    known = spark.sparkContext.broadcast(frequent)
    rows = both.join(changed, group, "left").select(*group, "id", "n", "kept", "hashes", "central", "changed")
    return io.written(rows.mapInArrow(lambda b: _rests(b, known.value, percent), REST), "rests")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) of every row of df.

    Words are runs of other characters than ASCII white space, with A-Z as a-z. A
    text's set is that of its shingles of `shingle` successive words, or with
    fewer words its whole sequence. Two texts link when percent of the union of
    their sets is common to both. component_id is the smallest key that links
    lead to, the row's own included.

    A text without words, or null, has an empty set and links with nothing.
    Rows that repeat a key are all returned, each with the smallest component_id
    of theirs. A row with a null key links with nothing and has a null component. An empty table gives an empty one. Sets count as
    equal when their 64-bit digests and sizes are.
    """
    rows = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    keyed = rows.where("key is not null")
    keys, _, frequent = shingle_sets(rows, "key", "text", shingle)
    pairs, members = candidates(keyed, "text", frequent, percent, shingle)
    real = keys.where("n > 0 and key is not null")
    pairs = io.written(pairs, "pairs")
    links = io.written(linked(pairs, real, keyed, "key", "text", percent, shingle), "links")
    roots = connected_components(links)
    # Sets that share a frequent signature, but are not in one component yet.
    placed = members.join(roots, members.id == roots.node, "left").select("sig", "id", "info", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("sets")).where("lo <> hi").select("sig", "sets")
    spare = F.shiftright("info", SIZE_BITS).bitwiseAND(SIZE_MASK)
    # Windows of the signatures of one set in one band.
    dearest = Window.partitionBy("id", F.shiftright("info", 2 * SIZE_BITS)).orderBy(F.desc("sets"), "sig")
    left = placed.join(mixed, "sig").withColumns({"kept": (F.col("sets") <= CHEAP) | (F.row_number().over(dearest) > spare), "n": F.col("info").bitwiseAND(SIZE_MASK)})
    left = io.written(left.select("sig", "id", "n", "sets", "kept"), "left")
    if not left.isEmpty():
        crowd = rests(left.where(F.col("sets") > CHEAP).select("sig", "id", "n", "kept"), real, keyed, "key", "text", frequent, percent, shingle)
        best = crowd.groupBy("center", "class").agg(F.min(F.struct("score", "id")).alias("best"))
        central = crowd.join(best, ["center", "class"]).where("score + best.score <= 0 and id <> best.id").select(F.col("id").alias("a"), F.col("best.id").alias("b"))
        # A component is linked already through its root.
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = io.written(connected_components(central.union(links)), "roots")
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        of_root = lambda rows: rows.join(roots, rows.id == roots.node, "left").withColumn("root", F.coalesce("root", "id")).drop("node")
        # An eighth of what linked sets of the class may differ in makes a class of scores.
        edges, q = F.array(*(F.lit(x).cast("long") for x in size_edges(percent))), shares(percent)[1]
        crowd = crowd.withColumn("width", F.greatest(F.lit(1).cast("long"), F.floor(F.element_at(edges, F.col("class")) * q / 4)))
        crowd = io.written(of_root(crowd.withColumn("mine", F.floor((F.col("score") + q * F.col("n_center")) / F.col("width")))), "crowd")
        apart = crowd.groupBy("center", "class").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_set("mine").alias("scores")).where("lo <> hi").select("center", "class", "scores")
        index = "key long, mine long, other long, id long, root long, n long, size long, kept boolean"
        met = io.written(crowd.join(apart, ["center", "class"]).mapInArrow(lambda b: _rest_index(b, percent), index), "met")
        few = of_root(left.where(F.col("sets") <= CHEAP)).select(F.col("sig").alias("key"), F.lit(0).alias("mine"), F.lit(0).alias("other"), "id", "root", "n", F.lit(0).alias("size"), "kept")
        near = (F.col("root") != F.col("root2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("kept") | F.col("kept2")) & (F.col("id") < F.col("id2"))
        pairs_of = lambda rows: rows.join(rows.select("key", F.col("mine").alias("other"), F.col("other").alias("mine"), *(F.col(c).alias(c + "2") for c in ("id", "root", "n", "kept"))), ["key", "mine", "other"]).where(near).select(F.col("id").alias("a"), F.col("id2").alias("b"))
        more = pairs_of(met).union(pairs_of(few)).distinct().join(pairs, ["a", "b"], "left_anti")
        new = io.written(linked(io.written(more, "pairs"), real, keyed, "key", "text", percent, shingle), "links")
        roots = connected_components(new.union(links))
    named = real.join(roots, real.id == roots.node, "left").select("key", F.coalesce("root", "id").alias("root"))
    smallest = named.groupBy("root").agg(F.min("key").alias("component"))
    by_key = named.join(smallest, "root").groupBy("key").agg(F.min("component").alias("component"))
    return keys.join(by_key, "key", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
