"""Connected components over a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum (partial aggregation first) and an equi-join, so a node with very many links is
split like any skewed join. Every round is written to the shared folder; nothing but a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(both: DataFrame, small: bool) -> DataFrame:
    """Point neighbours at the least node around ``a``: the larger ones, or with ``small`` the smaller ones and ``a``."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(least, "a")
    if small:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, component being the smallest node reachable.

    Self links and repeats are ignored; nodes without links do not appear. An empty table gives an empty table.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pair = materialize(pair, "links")
    last = _checksum(pair)
    while last[0]:
        turned = pair.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = materialize(_star(pair.unionByName(turned), small=False), "large")
        pair = materialize(_star(large, small=True), "small")
        now = _checksum(pair)
        if now == last:
            break
        last = now
    return pair.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pair.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
