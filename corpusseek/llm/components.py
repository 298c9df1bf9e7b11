"""Connected components by alternating large and small stars; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def _large(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Links every greater neighbour of a node to the least of the node and its neighbours; also returns what it wrote.

    The least ones are written first: a join of an aggregate with what it came from would take a hot node's edges in one task,
    while Spark can split that of two tables.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = write_shared(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "cc-least", rows)
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), least


def _small(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Links a node and its lesser neighbours to the least of them. ``a`` is less than ``b`` in every edge."""
    least = write_shared(edges.groupBy("b").agg(F.min("a").alias("m")), "cc-least", rows)
    moved = edges.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge. ``edges`` has long columns a and b.

    The edges end as one star for each component. They are kept in the shared folder between rounds, never on the driver; a
    star's hot centre meets its edges in aggregations combined before the shuffle and in joins that Spark can split. No round
    has more edges than there were at first.
    """
    now = write_shared(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    rows, mark = 2 * now.count(), None
    while rows:
        large, one = _large(now, rows)
        large = write_shared(large, "cc", rows)
        small, two = _small(large, rows)
        new = write_shared(small, "cc", rows)
        got = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
        for t in (now, large, one, two):
            drop_shared(t)
        now = new
        if (got["n"], got["s"]) == mark:
            break
        mark = (got["n"], got["s"])
    out = now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    out.shared_path = now.shared_path  # for drop_shared()
    return out
