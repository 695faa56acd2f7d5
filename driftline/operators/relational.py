"""Keyed writes, filters with reasons, ranked choices and set-like operations.

Writes are expressed as the next state of a table: a caller writes the result
to a new location or overwrites the partitions that changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys in which null equals null."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality with every value given; None leaves its column open."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def dynamic_null_safe(df: DataFrame, constrained: dict) -> DataFrame:
    """Null-safe equality for any subset of dimensions."""
    for name, value in constrained.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    return df


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that rejects; null where none does. An unknown condition rejects nothing."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def contains_ci(col: str, text: str | None) -> Column:
    """Case-insensitive substring search in which % and _ are wildcards; no text keeps all rows."""
    return F.lit(True) if not text else F.lower(col).like(f"%{text.lower()}%")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], newest: list[Column], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``target`` after the newest change of each key; columns of ``keep_if_null`` keep their value where the change has null."""
    both = target.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    order = [F.desc("_side"), *newest]
    w = Window.partitionBy(*keys).orderBy(*order)
    out = both.withColumn("_rn", F.row_number().over(w))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in keep_if_null:
        out = out.withColumn(c, F.first(c, ignorenulls=True).over(whole))
    return out.filter("_rn = 1").drop("_rn", "_side")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` and the first of the new rows of each key that it lacks."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
    return target.unionByName(first.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def replace_keys(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` give way to the new ones."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").select(*target.columns).unionByName(new)


def affected_grains(old: DataFrame, new: DataFrame, grain: list[str]) -> DataFrame:
    """Grains of the rows that went and of those that came."""
    return old.select(*grain).unionByName(new.select(*grain)).distinct()


def rebuild_grains(contributions: DataFrame, affected: DataFrame, grain: list[str], counts: list[str]) -> DataFrame:
    """Sums of the affected grains; a grain without contributions is not returned."""
    touched = contributions.join(affected, null_safe(contributions, affected, grain), "left_semi")
    return touched.groupBy(*grain).agg(*[F.sum(c).alias(c) for c in counts])


def replace_and_rebuild(old: DataFrame, key: str, replacement: Column, grain: list[str], counts: list[str]) -> DataFrame:
    """Sums of the grains that change when keys with a replacement give way to it, in one pass over ``old``.

    ``replacement``: a struct of the new row's grain and counts, null where the
    row has none; all rows of a key with one go. Grains left empty are not returned.
    """
    hit = F.bool_or(F.col("_new").isNotNull()).over(Window.partitionBy(key))
    row = lambda source, counted: F.struct(*[source(c).alias(c) for c in grain], *[(source(c) if counted else F.lit(0).cast("long")).cast("long").alias(c) for c in counts], F.lit(counted).alias("counted"))
    rows = old.withColumn("_new", replacement).withColumn("_hit", hit)
    parts = F.array_compact(F.array(row(F.col, True).withField("touched", F.col("_hit")).withField("counted", ~F.col("_hit")), F.when(F.col("_new").isNotNull(), row(lambda c: F.col(f"_new.{c}"), True).withField("touched", F.lit(True)))))
    each = rows.select(F.explode(parts).alias("r"))
    value = lambda c: F.when(F.col("r.counted"), F.col(f"r.{c}"))
    sums = each.groupBy(*[F.col(f"r.{c}").alias(c) for c in grain]).agg(*[F.sum(value(c)).alias(c) for c in counts], F.bool_or("r.touched").alias("_touched"), F.bool_or("r.counted").alias("_counted"))
    return sums.filter("_touched AND _counted").drop("_touched", "_counted")


def first_per_key(df: DataFrame, keys: list[str], *order: Column, null_keys_stay: bool = False) -> DataFrame:
    """The first row of each key; rows with a null key all stay if asked for."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    keep = F.col("_rn") == 1
    if null_keys_stay:
        keep |= F.col(keys[0]).isNull()
    return df.withColumn("_rn", rn).filter(keep).drop("_rn")


def capped_per_type(df: DataFrame, kind: str, cap: int, *order: Column) -> DataFrame:
    """At most ``cap`` rows of each type in order; a null type is not capped."""
    rn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.withColumn("_rn", rn).filter((F.col("_rn") <= cap) | F.col(kind).isNull()).drop("_rn")


def round_robin(df: DataFrame, region: str, k: int, *order: Column) -> DataFrame:
    """The first k rows that turns over the regions, in region order, would take.

    Each region gives k rows at most to the global choice.
    """
    rn = F.row_number().over(Window.partitionBy(region).orderBy(*order))
    return df.withColumn("turn", rn).filter(F.col("turn") <= k).orderBy("turn", region).limit(k)


def skyline(df: DataFrame, keys: list[str], cost: str, value: str, slack: float = 1e-9) -> DataFrame:
    """Rows whose value exceeds that of every cheaper row of the key."""
    before = Window.partitionBy(*keys).orderBy(F.asc(cost), F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(before)
    return df.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col(value) > F.col("_best") + slack)).drop("_best")


def violations(df: DataFrame, keys: list[str], open_row: Column) -> DataFrame:
    """Keys that have more than one open row, and how many: a partial unique index as a check."""
    return df.filter(open_row).groupBy(*keys).agg(F.count("*").alias("n_open")).filter("n_open > 1")
