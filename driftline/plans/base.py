"""How queries are registered, and the views of the given tables that they share.

The given tables have no positions, so ``points`` derives them from keys; the
same arithmetic stands in ``POINTS`` for the SQL side. Times are whole epoch
seconds in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL if there is any.

    The time column ``at`` is a keyword in DuckDB and is quoted here.
    """

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r'(?<!")\bat\b(?!")', '"at"', sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str | Column) -> Column:
    """Whole seconds of a time without zone, whatever the session's zone is."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def rounded(v: Column, digits: int) -> Column:
    """A number from 0 on rounded as in SQL; ``round`` would go through a decimal text for each of many pairs."""
    return F.floor(v * 10.0**digits + 0.5) / 10.0**digits


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("point_id"), epoch("ts").alias("at"),
        (F.lit(-79.0) + F.col("event_id") % 100 / F.lit(1000.0)).alias("lon"), (F.lit(44.0) + F.col("event_id") % 97 / F.lit(1000.0)).alias("lat"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind"), "value",
    )


POINTS = """points AS (SELECT user_id AS session_id, event_id AS point_id, epoch_us(ts) // 1000000 AS at,
  -79.0 + (event_id % 100) / 1000.0 AS lon, 44.0 + (event_id % 97) / 1000.0 AS lat,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, value FROM events)"""


def mean_scale_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """The mean-scale distance in SQL."""
    return f"(sqrt(({lon2} - {lon1}) * ({lon2} - {lon1}) + ({lat2} - {lat1}) * ({lat2} - {lat1})) * (111320.0 + 111320.0 * cos(radians(({lat1} + {lat2}) / 2))) / 2)"
