"""The list of queries and the SQL helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL for it if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: str | Column) -> Column:
    """Six decimals, never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def sql_hash(seed: int | str, *keys: str) -> str:
    parts = "||':'||".join(f"cast({k} as varchar)" for k in keys)
    return f"('0x'||substr(md5('{seed}:'||{parts}),1,8))::bigint"


def sql_r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0::double)"


def sql_text(value: str) -> str:
    """A string literal; line ends and other blanks are written as they are."""
    return "'" + value.replace("'", "''") + "'"
