"""Reproducible randomness: a hash of (seed, key) that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def portable_hash(seed: int | str, *keys: str | Column) -> Column:
    """First 32 bits of md5("seed:key[:key…]") as a non-negative long."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def coin(seed: int | str, *keys: str | Column) -> Column:
    """0 or 1, each with probability one half, fixed by (seed, keys)."""
    return (portable_hash(seed, *keys) % 2).cast("int")
