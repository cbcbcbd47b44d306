"""Merkle manifest of a table: a tree of digests per group, a tree over the groups, and a proof for every row.

Rows are ordered by group and key and dealt into leaf parts of successive rows.
A part digests what lies within it and gives away the nodes at its edges; the
nodes above are made from these in blocks of the tree. For the proofs every part
names the nodes that its leaves miss, all of them together and each once (the
siblings on the paths that no leaf of the part gives), fetches them, derives the
nodes that the paths share and writes out the proof of each leaf.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefops.llm.frames import bounded_batches
from prefops.sources import io

#: Rows of a leaf part, as a power of two.
PART_BITS = 12
#: Levels of a tree that one block of upper nodes spans.
BLOCK_BITS = 16
#: Rows that a task puts in order.
SORT_ROWS = 1 << 20
#: The number of the tree over the groups.
TOP = -1

#: `edge` says that a node's parent isn't made in the same part.
NODES = "tree long, size long, level int, idx long, hash string, edge boolean"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    return max(int(size) - 1, 0).bit_length()


def leaf_hash(fields: list[Column]) -> Column:
    """Digest of a row: each field as `-` if null, else its bytes in UTF-8, a colon and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256)


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with their place (`at`, from 0) in the order of the columns, nulls first, equal rows in any order.

    Ranges of the order are sorted each in a task; equal rows are told apart by a
    number, so that any number of them may be split. df is written first.
    """
    rows = io.written(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    by = [*columns, "__row"]
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORT_ROWS))
    dealt = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    dealt = io.written(dealt.drop("__row"), "ordered")
    # The upper bits of such an id are the task, the lower 33 the row of the task.
    task = F.shiftright("__id", 33)
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the sort.
    offsets = dealt.groupBy(task.alias("task")).count().select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    placed = dealt.withColumn("task", task).join(F.broadcast(offsets), "task")
    return placed.withColumn("at", F.col("offset") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "task", "offset")


class Manifest(NamedTuple):
    """leaves: part, at, hash, claimed, group, key; runs: the leaves of one tree within a part; nodes: those at edges and above."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    trees: int


def _nodes_table(rows: list[tuple]) -> pa.Table:
    types = {"tree": pa.int64(), "size": pa.int64(), "level": pa.int32(), "idx": pa.int64(), "hash": pa.string(), "edge": pa.bool_()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.table({n: pa.array(v, t) for (n, t), v in zip(types.items(), columns, strict=True)})


def _within(whole: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The nodes of a part whose parent needs leaves of other parts, and whole trees' roots; if `whole`, all it can make."""

    def run(leaves: pa.Table, runs: pa.Table) -> pa.Table:
        order = np.argsort(leaves["at"].to_numpy())
        hashes = leaves["hash"].take(pa.array(order)).to_pylist()
        at = leaves["at"].to_numpy()[order]
        out = []
        for run in runs.to_pylist():
            tree, size = run["tree"], run["size"]
            first = int(np.searchsorted(at, run["lo"]))
            nodes = hashes[first : first + run["n"]]
            lo, level, n = run["lo"] - run["start"], 0, size
            while nodes:
                hi = lo + len(nodes)
                left, right = n > 1 and lo & 1, n > 1 and hi & 1 and hi != n
                if whole:
                    out += [(tree, size, level, i, node, False) for i, node in enumerate(nodes, lo) if not (left and i == lo or right and i == hi - 1 or n == 1)]
                if n == 1:
                    out.append((tree, size, level, 0, nodes[0], True))
                    break
                if left:
                    out.append((tree, size, level, lo, nodes.pop(0), True))
                if right and nodes:
                    out.append((tree, size, level, hi - 1, nodes.pop(), True))
                nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
                lo, level, n = (lo + 1) >> 1, level + 1, (n + 1) >> 1
        return _nodes_table(out)

    return run


def _rise(top: int) -> Callable[[pa.Table], pa.Table]:
    """All nodes up to level `top` above the given ones, which cover a block of the tree."""

    def run(table: pa.Table) -> pa.Table:
        tree, size = table["tree"][0].as_py(), table["size"][0].as_py()
        levels: dict[int, dict[int, str]] = {}
        for level, idx, h in zip(table["level"].to_pylist(), table["idx"].to_pylist(), table["hash"].to_pylist(), strict=True):
            levels.setdefault(level, {})[idx] = h
        out = []
        for level in range(min(levels), min(top, height(size))):
            here, above = levels.get(level, {}), levels.setdefault(level + 1, {})
            n = -(-size // (1 << level))
            for idx in sorted(here):
                right = idx | 1
                if idx >> 1 in above or (idx & 1 and idx - 1 in here):
                    continue
                if idx & 1 or (right < n and right not in here):
                    raise RuntimeError("a node is missing: the leaves came differently the second time")
                above[idx >> 1] = digest(here[idx] + here.get(right, ""))
                out.append((tree, size, level + 1, idx >> 1, above[idx >> 1], True))
        return _nodes_table(out)

    return run


def build(leaves: DataFrame, runs: DataFrame, whole: bool) -> DataFrame:
    """The nodes of the trees at the edges of parts (if `whole`, within them too) and above, from leaves (part, at, hash) and their runs."""
    least = leaves.select("part", "at", "hash")
    nodes = io.written(least.groupBy("part").cogroup(runs.groupBy("part")).applyInArrow(_within(whole), NODES), "edges")
    edges = nodes.where("edge")
    largest = runs.agg(F.max("size")).first()[0] or 0
    ground, top = edges, BLOCK_BITS
    while top - BLOCK_BITS < height(largest):
        low = ground.where(F.col("level") < top)
        block = F.expr(f"shiftright(idx, {top} - level)")
        made = io.written(low.groupBy("tree", block).applyInArrow(_rise(top), NODES), "nodes")
        nodes = nodes.union(made)
        ground = edges.union(made).where(F.col("level") >= top)
        top += BLOCK_BITS
    return nodes


def roots(nodes: DataFrame) -> DataFrame:
    """The root of every tree."""
    bits = F.when(F.col("size") <= 1, 0).otherwise(F.length(F.bin(F.col("size") - 1)))
    return nodes.where(F.col("level") == bits).select("tree", "hash")


def manifest(df: DataFrame, leaf: Column, group: str, key: str, claimed: Column | None = None, whole: bool = True) -> Manifest:
    """Digest trees over the rows of df: one per value of `group`, and one over those.

    Within a group leaves ascend by key (null first), then by digest; groups
    ascend bytewise, null first. Every two successive nodes of a level become the
    digest of both, the last one alone the digest of itself, until one is left.
    `claimed` is a leaf that each row's proof is tried on in place of its own.
    Without `whole`, nodes that only leaves of one part need aren't kept: enough
    to prove all leaves, or whole parts, but not a choice of leaves.

    Repeated rows and keys are leaves of their own. An empty table has no nodes.
    Other columns aren't looked at.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf.alias("hash"), (leaf if claimed is None else claimed).alias("claimed"))
    leaves = in_order(rows, ["group", "key", "hash"]).withColumn("part", F.shiftright("at", PART_BITS))
    runs = io.written(leaves.groupBy("part", "group").agg(F.min("at").alias("lo"), F.count("*").alias("n")), "runs")
    trees = in_order(runs.groupBy("group").agg(F.min("lo").alias("start"), F.sum("n").alias("size")), ["start"])
    trees = io.written(trees.withColumnRenamed("at", "tree"), "trees")
    same = runs["group"].eqNullSafe(trees["group"])
    runs = io.written(runs.join(trees, same).select("part", "lo", "n", "start", "size", "tree"), "tree-runs")
    below = build(leaves, runs, whole)
    count = trees.count()
    tops = roots(below).select(F.shiftright("tree", PART_BITS).alias("part"), F.col("tree").alias("at"), "hash")
    top_runs = tops.groupBy("part").agg(F.min("at").alias("lo"), F.count("*").alias("n"))
    top_runs = top_runs.select("part", "lo", "n", F.lit(0).cast("long").alias("start"), F.lit(count).cast("long").alias("size"), F.lit(TOP).cast("long").alias("tree"))
    return Manifest(leaves, runs, below.union(build(tops, top_runs, True)), count)


def missing(at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(level, place) of the fewest nodes that, with the leaves at the sorted places `at`, give the root of a tree."""
    out, level, n = [], 0, size
    while n > 1:
        sibling = at ^ 1
        out += [(level, i) for i in np.setdiff1d(sibling[sibling < n], at).tolist()]
        at, level, n = np.unique(at >> 1), level + 1, (n + 1) >> 1
    return out


def _runs_within(at: np.ndarray, runs: pa.Table):
    """(tree, size, leaves from, to, their places) of the runs that have some of the leaves."""
    for run in sorted(runs.to_pylist(), key=lambda r: r["lo"]):
        lo, hi = np.searchsorted(at, [run["lo"], run["lo"] + run["n"]]).tolist()
        if lo < hi:
            yield run["tree"], run["size"], lo, hi, at[lo:hi] - run["start"]


def _needs(trees: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The coordinates that a part has to fetch: of its trees, of the tree over them, and the root."""

    def run(leaves: pa.Table, runs: pa.Table) -> pa.Table:
        out, seen = [], []
        for tree, size, _, _, places in _runs_within(np.sort(leaves["at"].to_numpy()), runs):
            out += [(tree, *c) for c in missing(places, size)]
            seen.append(tree)
        if seen:
            out += [(TOP, *c) for c in missing(np.array(seen), trees)] + [(TOP, height(trees), 0)]
        tree, level, idx = zip(*out, strict=True) if out else ([],) * 3
        part = pa.array([leaves["part"][0].as_py()] * len(out) if out else [], pa.int64())
        return pa.table({"part": part, "tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64())})

    return run


class Paths:
    """Nodes of a tree that some leaves and the fetched nodes give, and the proofs along them."""

    def __init__(self, hashes: dict[int, str], size: int, fetched: dict[tuple[int, int], str]):
        self.size, self.levels = size, [hashes]
        for level in range(height(size)):
            here = self.levels[level]
            n = -(-size // (1 << level))
            own = sorted({i >> 1 for i in here})
            for i in own:
                for child in (2 * i, 2 * i + 1):
                    if child < n and child not in here:
                        here[child] = fetched[level, child]
            self.levels.append({i: digest(here[2 * i] + here.get(2 * i + 1, "")) for i in own})
        self.root = self.levels[-1][0]

    def proofs(self) -> dict[int, str]:
        """The siblings from each leaf to the root, laid end to end; paths share their upper ends."""
        tails = {0: ""}
        for level in range(height(self.size) - 1, -1, -1):
            here = self.levels[level]
            tails = {i: here.get(i ^ 1, "") + tails[i >> 1] for i in here if i >> 1 in tails}
        return tails

    def folded(self, leaf: str, at: int) -> str:
        """The root that a leaf gives at a place with the siblings there."""
        for level in range(height(self.size)):
            sibling = self.levels[level].get(at ^ 1, "")
            leaf = digest(sibling + leaf if at & 1 else leaf + sibling)
            at >>= 1
        return leaf


def _expand(trees: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(leaves: pa.Table, side: pa.Table) -> pa.Table:
        names = ["key", "leaf", "subroot", "root", "proof", "folded_root"]
        if not len(leaves):
            return pa.table({n: pa.array([], leaves["key"].type if n == "key" else pa.string()) for n in names})
        leaves = leaves.take(pa.array(np.argsort(leaves["at"].to_numpy(), kind="stable")))
        is_run = side["hash"].is_null()
        fetched: dict[int, dict[tuple[int, int], str]] = {}
        got = side.filter(pc.invert(is_run))
        for tree, level, idx, h in zip(*(got[c].to_pylist() for c in ("tree", "level", "idx", "hash")), strict=True):
            fetched.setdefault(tree, {})[level, idx] = h
        hashes, claimed = leaves["hash"].to_pylist(), leaves["claimed"].to_pylist()
        within = list(_runs_within(leaves["at"].to_numpy(), side.filter(is_run)))
        paths = [Paths(dict(zip(p.tolist(), hashes[lo:hi], strict=True)), size, fetched.get(tree, {})) for tree, size, lo, hi, p in within]
        top = Paths({tree: p.root for (tree, *_), p in zip(within, paths, strict=True)}, trees, fetched[TOP])
        above, root = top.proofs(), fetched[TOP][height(trees), 0]
        subroot, proof, folded = [], [], []
        for (tree, _, lo, hi, places), p in zip(within, paths, strict=True):
            tails = p.proofs()
            subroot += [p.root] * (hi - lo)
            for at, leaf in zip(places.tolist(), claimed[lo:hi], strict=True):
                proof.append(tails[at] + above[tree])
                folded.append(top.folded(p.folded(leaf, at), tree))
        columns = [leaves["key"], leaves["hash"], *(pa.array(x, pa.string()) for x in (subroot, [root] * len(proof), proof, folded))]
        return pa.table(columns, names)

    return run


def prove(m: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded_root, verified) of the manifest's leaves, or of those given out of them.

    `proof` holds the siblings (the other node of each pair, if any) from the leaf
    to its group's root and on to the root of all, 64 hex digits each.
    `folded_root` is what the claimed leaf gives with them. Leaves may be
    any choice of rows; every part fetches the fewest nodes for its choice.
    """
    leaves = m.leaves if leaves is None else leaves
    spots = leaves.select("part", "at")
    needs = spots.groupBy("part").cogroup(m.runs.groupBy("part")).applyInArrow(_needs(m.trees), "part long, tree long, level int, idx long")
    got = needs.join(m.nodes.select("tree", "level", "idx", "hash"), ["tree", "level", "idx"])
    side = got.unionByName(m.runs, allowMissingColumns=True)
    rows = leaves.select("part", "at", "hash", "claimed", "key")
    kind = leaves.schema["key"].dataType
    types = f"key {kind.simpleString()}, leaf string, subroot string, root string, proof string, folded_root string"
    out = rows.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(_expand(m.trees), types)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
