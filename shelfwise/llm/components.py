"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import settled


def _total(edges: DataFrame) -> tuple:
    """An order-free fingerprint of the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node hands its smallest neighbour (itself included) to its larger (or its smaller) ones.

    The minimum is combined before the shuffle and settled before the join, so a node that a
    third of all edges share is an ordinary skewed join, which Spark splits.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = settled(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        out = sides.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        lowest = settled(edges.groupBy("a").agg(F.min("b").alias("m")))
        out = edges.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(lowest.select("a", F.col("m").alias("b")))
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (a, b), the component named by its smallest node.

    Alternating large-star and small-star steps until the edges are stars around the smallest
    nodes; the rounds grow with the logarithm of the nodes. Null ends and self-links are left out.
    """
    edges = settled(
        edges.filter("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while before != (now := _total(edges)):
        before = now
        edges = settled(_star(settled(_star(edges, True)), False))
    tops = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(tops)
