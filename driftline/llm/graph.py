"""Connected components of an edge table, by alternating large and small stars.

Each step is two aggregations and a join, and every edge moves towards the
smallest id of its component, so no vertex set is gathered anywhere. See
Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each vertex link to its smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and itself, link to its smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of each vertex that has an edge to another; component_id is the smallest id.

    Ids are longs. Loops, repeated edges, both directions of one edge and null
    ends are allowed; the last three change nothing.
    """
    now = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("a != b").distinct()
    now = materialise(now)
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.select(digest.alias("d")).first()["d"]
    while seen[0]:
        now = materialise(_small_star(_large_star(now)))
        found = now.select(digest.alias("d")).first()["d"]
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
