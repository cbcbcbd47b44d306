"""Reproducible order: dense shuffle index, shards, exact splits, first rows.

A global `row_number` sorts everything in one task. Here the first digit of the
key's hash picks one of 2**bits buckets, and in a bucket of more than `bound` keys
the second digit one of 2**bits parts. Counts of both give offsets, and a key's
index is its offset plus its place in its part. Only keys are counted and ranked;
rows take their index by a join. Bucket and part depend on the hash and the
number of keys, so a re-run task puts every row where it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefops.functions.rand import HASH_BITS, portable_hash
from prefops.schema import require

BUCKET_BITS = 12
# Keys that one task sorts; with 2**24 parts that is enough for 10**13 keys.
BOUND = 1_000_000


def _upto(last: int) -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, last)


def _digit(which: int, bits: int) -> Column:
    return F.shiftright("_h", HASH_BITS - which * bits).bitwiseAND((1 << bits) - 1)


def key_index(df: DataFrame, key: str, seed: int | str, bits: int = BUCKET_BITS, bound: int = BOUND) -> DataFrame:
    """(`__key`, `__index`): the 0-based place of every key in the order of (hash(seed, key), key)."""
    keys = df.select(F.col(key).alias("_k"), portable_hash(seed, key).alias("_h")).withColumn("_b", _digit(1, bits))
    sizes = keys.groupBy("_b").agg(F.count("*").alias("_n"))
    # At most 2**bits rows.
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(_upto(-1)), F.lit(0)).alias("_before"), (F.col("_n") > bound).alias("_large"))
    dealt = keys.join(F.broadcast(offsets), "_b").withColumn("_d", F.when(F.col("_large"), _digit(2, bits)).otherwise(0))
    # Parts of large buckets only; counted per task first, and dealt like the keys they are joined to.
    part_sizes = dealt.where("_large").groupBy("_b", "_d").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_b").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    parts = part_sizes.select("_b", "_d", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_within"))
    inside = Window.partitionBy("_b", "_d").orderBy("_h", "_k")
    again = F.raise_error(F.concat(F.lit("key repeats: "), F.coalesce(F.col("_k").cast("string"), F.lit("null")))).cast("long")
    number = F.row_number().over(inside)
    same = (number > 1) & F.lag("_k").over(inside).eqNullSafe(F.col("_k"))
    placed = dealt.withColumn("_place", F.when(same, again).otherwise(number))
    index = F.col("_before") + F.coalesce(F.col("_within"), F.lit(0)) + F.col("_place") - 1
    return placed.join(parts, ["_b", "_d"], "left").select(F.col("_k").alias("__key"), index.cast("long").alias("__index"))


def dense_index(
    df: DataFrame, key: str, seed: int | str, name: str = "shuffle_index", bits: int = BUCKET_BITS, bound: int = BOUND
) -> DataFrame:
    """Add a 0-based dense index in the order of (hash(seed, key), key).

    `key` must be unique; a key that repeats, null included, is an error. The keys of `df` are read three
    times, and whole rows once if there are other columns, so it should be a table or a plan that is cheap to repeat.
    """
    require(df, key)
    indexed = key_index(df, key, seed, bits, bound)
    if df.columns == [key]:
        return indexed.select(F.col("__key").alias(key), F.col("__index").alias(name))
    rows = df.drop(name) if name != key else df
    # Null-safe: the one null key has its place too.
    joined = rows.join(indexed, rows[key].eqNullSafe(indexed["__key"]))
    return joined.drop("__key").withColumnRenamed("__index", name)


def shuffle_index(df: DataFrame, key: str, seed: int | str = 42, name: str = "shuffle_index") -> DataFrame:
    """A reproducible permutation of the rows as an index column."""
    return dense_index(df, key, seed, name=name)


def shard(df: DataFrame, n: int, idx: int, key: str, seed: int | str = 0) -> DataFrame:
    """Shard `idx` (0-based) of `n` after a shuffle; sizes differ by at most one."""
    if not 0 <= idx < n:
        raise ValueError(f"shard {idx} of {n}")
    return shuffle_index(df, key, seed).where(F.col("shuffle_index") % n == idx)


def train_val_split(
    df: DataFrame, key: str, frac: float = 0.2, seed: int | str = 42, name: str = "is_val", bits: int = BUCKET_BITS
) -> DataFrame:
    """Mark exactly ceil(frac · n) rows, the first in hash order, as validation.

    Only the last marked (hash, key) is looked for, among the keys of the one
    bucket it falls into. The rows themselves are compared with it where they
    are, so wide rows are not shuffled. Keys are expected to be unique; a last
    key that repeats, which would mark more rows, is an error.
    """
    require(df, key)
    hashes = df.select(F.col(key).alias("_k"), portable_hash(seed, key).alias("_h"))
    hashes = hashes.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))
    sizes = hashes.groupBy("_b").agg(F.count("*").alias("_n"))
    reach = sizes.select(
        "_b",
        F.coalesce(F.sum("_n").over(_upto(-1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(_upto(0)).alias("_to"),
        F.ceil(F.sum("_n").over(Window.partitionBy(F.lit(0))) * F.lit(float(frac))).alias("_want"),
    )
    border = reach.where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_to")))
    # `border` has at most one row.
    near = hashes.join(F.broadcast(border.select("_b", (F.col("_want") - F.col("_before")).alias("_r"))), "_b")
    inside = Window.partitionBy("_b").orderBy("_h", "_k")
    again = F.raise_error(F.concat(F.lit("key repeats: "), F.col("_k").cast("string"))).cast("long")
    placed = near.withColumns({"_place": F.row_number().over(inside), "_next": F.lead("_k").over(inside)})
    last = placed.where(F.col("_place") == F.col("_r")).select(
        F.struct(F.when(F.col("_next") == F.col("_k"), again).otherwise(F.col("_h")).alias("_h"), "_k")
    )
    mine = F.struct(portable_hash(seed, key).alias("_h"), F.col(key).alias("_k"))
    return df.withColumn(name, F.coalesce(mine <= last.scalar(), F.lit(False)))


def take(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First n rows in the given order."""
    return df.orderBy(*order).limit(n)
