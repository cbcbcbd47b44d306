"""Packing short samples into blocks of a fixed token count."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.functions.rand import portable_hash
from prefops.schema import require
from prefops.sources.io import written

#: Rows that are ranked together.
ROWS_PER_BUCKET = 1_000_000


def pack_sequences(
    df: DataFrame,
    key: str = "id",
    len_col: str = "length",
    block: int = K.MAX_SEQUENCE_TOKENS,
    seed: int | str = 0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Place every row in a block: (key, length, block, offset).

    Rows are packed longest first, each into the fullest block that still has
    room. This is decided on the histogram of lengths (`plan_blocks`), which has
    at most `block` + 2 entries however many rows there are, so fill does not
    depend on how rows are spread. The plan gives, for the rank of a row among
    those of its length, its block and offset. Ranks follow the hash of the key:
    the rows of a length are dealt to hash buckets of about `rows_per_bucket`,
    so keys should be unique; one that repeats is ranked in one task.

    A row longer than a block gets a block of its own. Keys and lengths are
    written to the shared folder first, so that the lengths are computed once,
    and nothing but them is moved. A null or negative length is an error; no
    rows give no blocks.
    """
    require(df, key, len_col)
    length = F.col(len_col).cast("long")
    length = F.when(length >= 0, length).otherwise(F.raise_error(F.lit("row without a length")).cast("long"))
    narrow = written(df.select(F.col(key), length.alias("length")), "lengths")
    size = F.least("length", F.lit(block + 1)).alias("_size")
    counts = {r["_size"]: r["n"] for r in narrow.groupBy(size).agg(F.count("*").alias("n")).collect()}
    plan = [
        (n, math.ceil(counts[n] / rows_per_bucket), *map(list, zip(*runs)))
        for n, runs in plan_blocks(counts, block).items()
    ]
    steps = df.sparkSession.createDataFrame(
        plan, "_size long, _buckets long, _from array<long>, _block array<long>, _each array<long>, _used array<long>"
    )
    most = max((len(p[2]) for p in plan), default=1)
    dealt = (
        narrow.withColumn("_size", size)
        .join(F.broadcast(steps), "_size")
        .withColumn("_bucket", F.pmod(portable_hash(seed, key), F.col("_buckets")))
    )
    group = ["_size", "_bucket"]
    before = Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group).agg(F.count("*").alias("_n"))
    starts = starts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_bucket = F.row_number().over(Window.partitionBy(*group).orderBy(portable_hash(seed, key), key, "length"))
    ranked = dealt.withColumn("_rank", in_bucket - 1).join(starts, group)
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_start"))
    ranked = ranked.withColumn("_run", _last_from(F.col("_from"), F.col("_rank"), most))
    in_run = F.col("_rank") - F.get("_from", "_run")
    each = F.get("_each", "_run")
    return ranked.select(
        key,
        "length",
        (F.get("_block", "_run") + F.floor(in_run / each)).alias("block"),
        (F.get("_used", "_run") + in_run % each * F.col("length")).alias("offset"),
    )


def _last_from(starts: Column, rank: Column, most: int) -> Column:
    """Index of the last of at most `most` ascending starts that is not above the rank, by bisection; the first is 0."""
    halves = [1 << i for i in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(h) for h in halves]),
        F.lit(0),
        lambda at, step: F.when(F.get(starts, at + step) <= rank, at + step).otherwise(at),
    )


def plan_blocks(counts: Mapping[int, int], block: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best fit, longest first, on a histogram: runs (first rank, first block, rows a block, tokens used before) per length.

    Blocks that are filled alike have successive numbers and are handled as one,
    so the work grows with the different lengths and not with the rows. Entry
    `block` + 1 of the histogram stands for all rows longer than a block.
    """
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    alike: list[tuple[int, int, int]] = []  # (tokens left, first block, blocks), sorted
    made = 0
    for size in sorted((n for n in counts if 0 < n <= block), reverse=True):
        left, runs = counts[size], []
        while left:
            at = bisect_left(alike, (size, -1, -1))
            if at < len(alike):
                room, first, blocks = alike.pop(at)
            else:
                per_block = block // size
                room, first, blocks = block, made, max(1, left // per_block)
                made += blocks
            each = min(room // size, left)
            used = min(blocks, left // each)
            runs.append((counts[size] - left, first, each, block - room))
            left -= used * each
            if used < blocks:
                insort(alike, (room, first + used, blocks - used))
            insort(alike, (room - each * size, first, used))
        plan[size] = runs
    if 0 in counts:
        # Empty rows lie at the end of the first block.
        room = next((room for room, first, _ in alike if first == 0), block)
        plan[0] = [(0, 0, counts[0], block - room)]
        made = max(made, 1)
    if block + 1 in counts:
        plan[block + 1] = [(0, made, 1, 0)]
    return plan
