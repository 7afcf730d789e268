"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from diamondframe.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b) of whole numbers: the smallest node each can reach.

    Alternately every node hands its smallest neighbour to its larger ones and to its smaller
    ones, until all edges lead to the smallest node of a component. Each pass is a grouping that
    is reduced before the shuffle; edges never become more. Only a number goes to the driver.
    """
    pairs = written(_edges(edges), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, _ = _towards_least(both, F.col("b") > F.col("a"))
        moved, least = _towards_least(large, F.lit(True))
        small = _edges(moved.unionByName(least.select("a", F.col("least").alias("b"))))
        after = written(small, "edges")
        if _sum(after) == _sum(pairs):
            break
        pairs = after
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _towards_least(edges: DataFrame, which) -> tuple[DataFrame, DataFrame]:
    """Edges from the chosen neighbours of each node to its smallest one; the smallest ones.

    These are written, so that the adaptive join can split a node with very many neighbours.
    """
    least = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    moved = edges.filter(which).join(least, "a")
    return _edges(moved.select(F.col("b").alias("a"), F.col("least").alias("b"))), least


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return pairs.filter("a <> b").select(larger, smaller).distinct()


def _sum(pairs: DataFrame):
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
