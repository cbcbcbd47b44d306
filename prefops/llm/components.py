"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.sources import io


def connected_components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of a link (a, b); the root is the component's smallest node.

    Alternates two steps until no link changes: every node sends its larger
    neighbours to its smallest one, then its smaller neighbours. Each step is a
    grouped minimum and a join, so no node's neighbours are gathered, and paths
    shorten by a constant factor. Links of a node with itself are kept out; an
    empty table gives an empty one.
    """
    edges = io.written(_canonical(links.select("a", "b")), "links")
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _canonical(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Here a > b in every row, so a node's smaller neighbours are its rows.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = io.written(_canonical(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def _canonical(links: DataFrame) -> DataFrame:
    """Different links with the larger node first."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
