"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm._io import dropped, written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: neighbours of each node move to the smallest of the neighbourhood.

    The large star moves larger neighbours, the small star the smaller ones and the node.
    Minima combine before the shuffle, and a node with very many edges is split by the
    adaptive join, as nothing gathers its neighbours.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    Each round writes its edges to the shared folder; only their number and a checksum come
    to the driver.  It ends when a round changes nothing.
    """
    spark = edges.sparkSession
    now, old = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    before = _mark(now)
    while before[0]:
        # written after each star: plans stay small, and nothing upstream runs again
        large, between = written(_star(now, True))
        now, path = written(_star(large, False))
        dropped(spark, old)
        dropped(spark, between)
        old = path
        seen = _mark(now)
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct().toDF("node", "component"))
