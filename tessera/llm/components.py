"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014), in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A node with more than a SHARE-th of all edges is split in joins; there are fewer than SHARE such nodes, so they can be broadcast.
SHARE = 1000


def _beside(edges: DataFrame, least: DataFrame, key: str, other: str, total: int, how: str) -> DataFrame:
    """Joins the edges to `least` by `key`; rows of a hot node are dealt by a hash of their other end, and its row of `least` goes to each part."""
    hot = edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * SHARE > total).select(key, F.ceil(F.col("_n") * SHARE / F.lit(total)).cast("int").alias("_k"))
    hot = F.broadcast(hot)
    rows = edges.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    sides = least.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_k", F.lit(1)) - 1))).drop("_k")
    return rows.join(sides.hint("merge"), [key, "_part"], how).drop("_part")


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each node's greater neighbours move to its least neighbour, or stay where it has no lesser one."""
    least = edges.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"))
    return _beside(edges, least, "a", "b", total, "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its lesser neighbours move to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = _beside(edges, least, "b", "a", total, "inner").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of the edges (a, b): the least id it reaches. Edges from a node to itself or with a null end are left out. Rounds go on until the
    table is its own image, when every node hangs on one root; their number grows with the logarithm of the table."""
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = lambda: tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state()
    while before[0]:
        big = written(_large(edges, before[0]), "large-stars")
        edges = written(_small(big, before[0]), "small-stars")
        if (now := state()) == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)
