"""A stated set of queries against all rows, in blocks: rows packed by key, tiles of queries meeting blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def finite(vector: Column) -> Column:
    """Whether a vector is there and no component of it is null, NaN or infinite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def parts_of(df: DataFrame, rows: int, most: int, least: int = 1024) -> int:
    """Parts of at most ``most`` rows or so; more of them, of ``least`` rows or so, where tasks would be idle."""
    return max(1, -(-rows // most), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // least)))


def dealt(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """Rows with the part that their ``row`` is dealt to."""
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))


def packed(rows: DataFrame, key: str, pack: Callable[[pa.Table], dict[str, object]], schema: str) -> DataFrame:
    """One row (key, *schema) for each key, made by ``pack`` from the key's rows."""

    schema = f"{key} int, {schema}"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(group: pa.Table) -> pa.Table:
        made = {key: group.column(key)[0].as_py(), **pack(group)}
        return pa.table({f.name: pa.array([v.tobytes() if isinstance(v := made[f.name], np.ndarray) else v], f.type) for f in fields})

    return rows.groupBy(key).applyInArrow(run, schema)


def everywhere(packs: DataFrame, name: str, parts: int) -> DataFrame:
    """A copy of each pack for every part of the other side."""
    return packs.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def meet(tiles: DataFrame, blocks: DataFrame, run: Callable[[dict, dict], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows that ``run`` makes of the two packs of each key (tile, block) that both sides have."""

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        made = run(left.to_pylist()[0], right.to_pylist()[0])
        return pa.table({f.name: pa.array(made[f.name], f.type) for f in fields})

    return tiles.groupBy("tile", "block").cogroup(blocks.groupBy("tile", "block")).applyInArrow(both, schema)


def first_ones(found: DataFrame, n: int, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their rank from 1."""
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` smallest scores, ties to the smaller id, in that order."""
    at = np.arange(len(scores))
    if len(scores) > n:
        at = np.nonzero(scores <= np.partition(scores, n - 1)[n - 1])[0]
    return at[np.lexsort((ids[at], scores[at]))][:n]
