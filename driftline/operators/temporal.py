"""Joins and windows over time, composed from DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_order: str, values: list[str], prefix: str) -> DataFrame:
    """Each left row with the values of the last right row at or before its time.

    Of right rows at one time the one with the greatest ``right_order`` counts.
    Both sides go through one sort by key and time, so there is no range join
    to blow up. Values keep their names behind ``prefix``.
    """
    value = F.struct(F.col(right_time).alias("_at"), *values)
    both = left.select("*", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_right"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_o")).unionByName(
        right.select(*keys, value.alias("_right"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(right_order).cast("long").alias("_o")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*left.columns, *[F.col(f"_found.{v}").alias(f"{prefix}{v}") for v in values])


def interval_buckets(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each time bucket that the half-open interval touches."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def contained_in(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, width: int = 3600) -> DataFrame:
    """Inner join of points with the intervals [start, end) that hold them, bucket by bucket."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    i = interval_buckets(intervals.filter(F.col(end) > F.col(start)), start, end, width)
    return p.join(i, [*keys, "_bucket"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_interval: tuple[str, str], right_interval: tuple[str, str], width: int = 3600) -> DataFrame:
    """Pairs whose intervals share time, once each, with the shared part as overlap_start and overlap_end."""
    (ls, le), (rs, re) = left_interval, right_interval
    a = interval_buckets(left.filter(F.col(le) > F.col(ls)), ls, le, width)
    b = interval_buckets(right.filter(F.col(re) > F.col(rs)), rs, re, width)
    start, end = F.greatest(ls, rs), F.least(le, re)
    both = a.join(b, [*keys, "_bucket"]).filter(start < end)
    # The pair is kept in the bucket in which its shared part begins.
    return both.filter(F.col("_bucket") == F.floor(start / width)).withColumns({"overlap_start": start, "overlap_end": end}).drop("_bucket")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column) -> DataFrame:
    """An ``island`` number within each key, one higher at every row where ``breaks`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(breaks, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def union_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Time covered by overlapping or touching intervals, once, for each key."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reached = df.filter(F.col(end) > F.col(start)).withColumn("_reached", F.max(end).over(before))
    apart = islands(reached, keys, [start, end], F.col("_reached").isNull() | (F.col(start) > F.col("_reached")))
    merged = apart.groupBy(*keys, "island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    return merged.groupBy(*keys).agg(F.sum(F.col("_e") - F.col("_s")).alias("covered"), F.count("*").alias("n_islands"))


def split_at(df: DataFrame, start: str, end: str, bounds: Column) -> DataFrame:
    """Cut [start, end) at the sorted ``bounds`` inside it; part_start and part_end of each part."""
    inside = F.filter(bounds, lambda b: (b > F.col(start)) & (b < F.col(end)))
    cuts = F.concat(F.array(start), inside, F.array(end))
    parts = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.struct(F.element_at(cuts, i).alias("s"), F.element_at(cuts, i + 1).alias("e")))
    return df.withColumn("_part", F.explode(parts)).withColumns({"part_start": F.col("_part.s"), "part_end": F.col("_part.e")}).drop("_part")


def streaks(df: DataFrame, keys: list[str], order: list[str], counts: Column, resets: Column) -> DataFrame:
    """``streak``: rows that count since the last reset, at each row that counts; others are dropped."""
    numbered = islands(df, keys, order, resets)
    w = Window.partitionBy(*keys, "island").orderBy(*order)
    return numbered.filter(counts).withColumn("streak", F.row_number().over(w)).drop("island")
