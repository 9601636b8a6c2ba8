"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on edges, until all components are stars; no edge comes to the driver. A node may have very
many edges: minima are combined before the shuffle, and the joins are salted by the other end of an edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: Parts into which the edges of a node are dealt for a join; the other side, one row per node, is copied to each. AQE splits
#: a part that is still too large: both sides are shuffled for this join alone.
SALTS = 2


def _joined(edges: DataFrame, least: DataFrame, node: str, other: str) -> DataFrame:
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [node, "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).withColumnsRenamed({"hi": "u", "lo": "v"})
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return _joined(both.where("v > u"), least, "u", "v").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = _joined(edges, least, "hi", "lo").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.withColumnRenamed("m", "lo")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either the end of one edge or the centre of some: then centres are components."""
    ends = edges.select(F.col("hi").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("lo").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node that it reaches.

    Loops, nulls and repeated edges count for nothing. An empty table gives no rows. Each round's table goes once the next
    one is written; the last one stays, since the result reads it.
    """
    pairs = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    pairs = written(pairs, "edges")
    while not _are_stars(pairs):
        last, pairs = pairs, written(_small_star(_large_star(pairs)), "edges")
        drop(last)
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
