"""Queries that run staged jobs and count what a pass meets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.operators import routes, staged
from driftline.operators.lineage import checkpoint_folder
from driftline.plans.base import POINTS, points, query
from driftline.plans.routing import _CELLS_SQL, placed


def _count(test):
    return F.count(F.when(test, 1))


@query(
    f"WITH {POINTS}, c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE kind = 'view') AS views, count(*) FILTER (WHERE value IS NULL) AS unvalued, count(*) FILTER (WHERE k > 50) AS deep, max(k) AS deepest, sum(k) AS depths FROM points) "
    "SELECT unnest(['rows', 'views', 'unvalued', 'deep', 'deepest', 'depths']) AS counter, CAST(unnest([rows, views, unvalued, deep, deepest, depths]) AS BIGINT) AS n FROM c"
)
def agg_diagnostic_counters(spark, d):
    """Counters of a run, gathered in the pass that writes its result."""
    counters = {"rows": F.count(F.lit(1)), "views": _count(F.col("kind") == "view"), "unvalued": _count(F.col("value").isNull()), "deep": _count(F.col("k") > 50), "deepest": F.max("k"), "depths": F.sum("k")}
    found = staged.counted(points(spark, d), f"{checkpoint_folder(spark)}/counted-{uuid.uuid4().hex}", counters)
    return spark.createDataFrame(list(found.items()), "counter string, n long")


_TARGETS_SQL = f"""WITH {_CELLS_SQL}, beside AS (SELECT DISTINCT c.area, c.x, c.y FROM cells c JOIN cells n ON n.area = c.area AND abs(n.x - c.x) + abs(n.y - c.y) = 1),
targets AS (SELECT event_id, area, x, y FROM placed JOIN beside USING (area, x, y)), zones AS (SELECT area, x // 8 AS zx, y // 8 AS zy, count(*) AS members FROM targets GROUP BY ALL HAVING count(*) >= 20)"""


@query(
    f"""{_TARGETS_SQL} SELECT area, (SELECT count(*) FROM cells c WHERE c.area = a.area) AS cells, (SELECT count(*) FROM targets t WHERE t.area = a.area) AS targets,
  (SELECT count(*) FROM zones z WHERE z.area = a.area) AS zones, CAST(coalesce((SELECT sum(members) FROM zones z WHERE z.area = a.area), 0) AS BIGINT) AS members FROM (SELECT DISTINCT area FROM cells) a"""
)
def alg_snapshot_build(spark, d):
    """A snapshot built in stages, each kept: raster, targets, zones, and the published summary."""

    def raster(_):
        return routes.passable_moves(placed(spark, d).select("area", "x", "y").distinct())

    def targets(made):
        return placed(spark, d).join(made["RASTER"].filter("moves <> 0").select("area", "x", "y"), ["area", "x", "y"])

    def zones(made):
        return made["TARGETS"].groupBy("area", F.floor(F.col("x") / 8).alias("zx"), F.floor(F.col("y") / 8).alias("zy")).agg(F.count("*").alias("members")).filter("members >= 20")

    def ready(made):
        count = lambda name, *more: made[name].groupBy("area").agg(F.count("*").alias(name.lower()), *more)
        joined = count("RASTER").withColumnRenamed("raster", "cells").join(count("TARGETS"), "area", "left").join(count("ZONES", F.sum("members").alias("members")), "area", "left")
        return joined.na.fill(0)

    folder = f"{checkpoint_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    staged.StagedJob(spark, folder, "v1", [("RASTER", raster), ("TARGETS", targets), ("ZONES", zones), ("READY", ready)]).run()
    return staged.published(spark, folder, "READY")
