"""Connected components of an edge table by alternating star contractions, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _two_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a`` and ``b``, long); the root is the least node reached.

    Each round links every node's larger neighbours to its least neighbour, then its smaller neighbours to the
    least; the number of rounds follows the logarithm of the number of nodes. Tables are written to the shared
    folder between rounds, and only a count and a hash reach the driver. Repeated edges count once, an edge of a node with
    itself makes a component of its own, rows with a null end aren't edges, and an empty table gives no rows.
    """
    edges = edges.where("a is not null and b is not null").select("a", "b")
    nodes = _two_ways(edges).select(F.col("a").alias("node")).distinct()
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(e)
    while before[0]:
        both = _two_ways(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = stored(small, "edges")
        after = _digest(e)
        if after == before:
            break
        before = after
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
