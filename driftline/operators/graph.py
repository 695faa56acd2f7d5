"""Connected components by contraction, and greedy choices along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.lineage import checkpointed, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _nearer_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Each vertex ties its larger (else its smaller) neighbours to the least one it knows."""
    known = _both_ways(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = known.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = known.join(least, "a").filter("b > a" if larger else "b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.filter("a <> least").select("a", F.col("least").alias("b"))
    return (tied if larger else tied.unionByName(own)).filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the vertices of ``edges`` (a, b): the least vertex that can be reached.

    Steps to larger and to smaller neighbours alternate until stars are left;
    the rounds grow with the logarithm of the vertices, and no vertex's
    neighbours are gathered. Vertices may be of any type that has an order.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct())
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    before = None
    while before != (now := print_of(edges)):
        before = now
        edges = written(_nearer_least(_nearer_least(edges, True), False))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def greedy_independent(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids (id) that a walk in order keeps if it has kept none of those above them; ``edges``: (id, above), above coming first.

    An id is settled once all above it are; each round settles the tops that
    are left, so the result is the walk's without one.
    """
    edges = checkpointed(edges.select("id", "above").distinct())
    dropped = None
    while not edges.isEmpty():
        tops = edges.select(F.col("above").alias("id")).distinct().join(edges.select("id").distinct(), "id", "left_anti")
        lost = checkpointed(edges.join(tops.withColumnRenamed("id", "above"), "above", "left_semi").select("id").distinct())
        dropped = lost if dropped is None else dropped.unionByName(lost)
        edges = edges.join(lost, "id", "left_anti").join(lost.withColumnRenamed("id", "above"), "above", "left_anti").select("id", "above")
        edges = checkpointed(edges.join(tops.withColumnRenamed("id", "above"), "above", "left_anti").select("id", "above"))
    return ids if dropped is None else ids.join(dropped, "id", "left_anti")
