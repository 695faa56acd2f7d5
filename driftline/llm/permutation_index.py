"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in the order of their distance.
The index deals all vectors into shards; a shard holds an inverted file for
each pivot, with the vectors that have it among their nearest and its place
there, by place. A query reads the files of its own nearest pivots and adds up
what each says on the footrule distance of the two orders (a pivot that one side
lacks counts as the place after the last). The rows nearest by footrule, ties at
the end included, are ranked again by exact Euclidean distance.

Pivots come from a bounded sample (``SAMPLE`` rows, about); every row is indexed.
A shard ranks a share of its rows again, so the work of a query follows the
rows; the share is what recall is bought with.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null id, take no part; a shorter vector is padded
with zeros; an id on several rows is several queries and several neighbours, and
a row is never its own; equal vectors are ties; fewer rows than asked for are all
returned; an empty table gives no rows; other columns are ignored. Distances too
large for a double are infinite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm import vector_tiles as tiles
from driftline.llm.shared import stored

#: Pivots, how many of them represent a vector, and rows that pivots are picked from, about.
PIVOTS, PLACES, SAMPLE = 256, 128, 16_384
#: Rows of a shard and of a tile of queries; a local number has two bytes, so a shard must stay below 65,536.
SHARD, TILE = 16_384, 4_096
#: Share of a shard's rows that is ranked again, and the least number of them.
SHARE, LEAST = 0.1, 256

_SHARD_SCHEMA = "rows binary, ids binary, vectors binary, starts binary, numbers binary, places binary"


def pivots_of(rows: DataFrame, n: int, width: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """(pivots, width): different vectors of the sampled rows (row, embedding), fewer if there are not so many."""
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(-(-n // sample))) == 0).groupBy("embedding").agg(F.xxhash64("embedding").alias("order"))
    picked = some.orderBy("order", "embedding").limit(pivots).select("embedding").toArrow()
    return tiles.matrix(picked.column(0), width)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """(rows, places): numbers of the nearest pivots, nearest first, ties to the smaller number."""
    # both sides scaled alike, so that squares stay finite
    scale = max(np.abs(vectors).max(initial=0), np.abs(pivots).max(initial=0), 1e-300)
    v, p = vectors / scale, pivots / scale
    return np.argsort((p * p).sum(axis=1)[None] - 2 * v @ p.T, axis=1, kind="stable")[:, :places].astype(np.int64)


def _posted(pivots: np.ndarray, places: int):
    """A shard's rows to its vectors and inverted files."""

    def pack(group: pa.Table) -> dict[str, object]:
        vectors = tiles.matrix(group.column("embedding"), pivots.shape[1])
        near = nearest_pivots(vectors, pivots, places)
        number, place = np.divmod(np.arange(near.size), places)
        by = np.lexsort((number, place, near.ravel()))
        starts = np.searchsorted(near.ravel()[by], np.arange(len(pivots) + 1))
        return {
            "rows": group.column("row").to_numpy().astype(np.int64), "ids": group.column("vec_id").to_numpy().astype(np.int64), "vectors": vectors,
            "starts": starts.astype(np.int64), "numbers": number[by].astype(np.uint16), "places": place[by].astype(np.uint16),
        }

    return pack


def closeness(query: np.ndarray, starts: np.ndarray, numbers: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """What the inverted files of a query's pivots take off the greatest footrule distance of each of ``n`` rows, halved."""
    k = len(query)
    got = np.zeros(n, np.int32)
    for mine, pivot in enumerate(query):
        at = slice(starts[pivot], starts[pivot + 1])
        got[numbers[at]] += k - np.maximum(places[at].astype(np.int32), mine)
    return got


def _searched(pivots: np.ndarray, places: int, neighbours: int, share: float, least: int):
    width = pivots.shape[1]

    def run(tile: dict, shard: dict) -> dict[str, np.ndarray]:
        whole = {k: np.frombuffer(shard[k], kind) for k, kind in (("rows", np.int64), ("ids", np.int64), ("starts", np.int64), ("numbers", np.uint16), ("places", np.uint16))}
        vectors = np.frombuffer(shard["vectors"], np.float64).reshape(-1, width)
        n = len(vectors)
        rows, ids, queries = np.frombuffer(tile["rows"], np.int64), np.frombuffer(tile["ids"], np.int64), np.frombuffer(tile["vectors"], np.float64).reshape(-1, width)
        again = max(least, int(np.ceil(share * n))) + 1  # one for the query itself
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "query_id", "vec_id", "score")}
        for row, own, query, near in zip(rows, ids, queries, nearest_pivots(queries, pivots, places)):
            got = closeness(near, whole["starts"], whole["numbers"], whole["places"], n)
            at = np.arange(n) if again >= n else np.nonzero(got >= np.partition(got, n - again)[n - again])[0]
            at = at[whole["rows"][at] != row]
            with np.errstate(over="ignore"):
                far = np.sqrt(((vectors[at] - query) ** 2).sum(axis=1))
            first = tiles.best(far, whole["ids"][at], neighbours)
            for k, v in (("row", np.full(len(first), row)), ("query_id", np.full(len(first), own)), ("vec_id", whole["ids"][at[first]]), ("score", far[first])):
                out[k].append(v)
        return {k: np.concatenate(v) for k, v in out.items()}

    return run


def nearest(vectors: DataFrame, queries: Column, neighbours: int = 10, pivots: int = PIVOTS, places: int = PLACES, share: float = SHARE, least: int = LEAST, shard: int = SHARD, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` (vec_id, embedding) for which ``queries`` holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    usable = F.col("vec_id").isNotNull() & tiles.finite(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stored(rows.filter(usable).withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asked"), F.max(F.size("embedding")).alias("width")).first()
    if not size["asked"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = pivots_of(rows, size["n"], size["width"], pivots)
    places = min(places, len(chosen))
    shards = tiles.parts_of(rows, size["n"], shard, least=max(least, 2048))
    groups = max(-(-size["asked"] // tile), min(-(-size["asked"] // 32), -(-tiles.parts_of(rows, size["n"], shard, 1) // shards)))
    index = stored(tiles.packed(tiles.dealt(rows, "block", shards), "block", _posted(chosen, places), _SHARD_SCHEMA))
    width = size["width"]
    plain = lambda group: {"rows": group.column("row").to_numpy().astype(np.int64), "ids": group.column("vec_id").to_numpy().astype(np.int64), "vectors": tiles.matrix(group.column("embedding"), width)}
    asked = tiles.packed(tiles.dealt(rows.filter("asks"), "tile", groups), "tile", plain, "rows binary, ids binary, vectors binary")
    met = tiles.meet(tiles.everywhere(asked, "block", shards), tiles.everywhere(index, "tile", groups), _searched(chosen, places, neighbours, share, least), "row long, query_id long, vec_id long, score double")
    return tiles.first_ones(met, neighbours, ["row"], [F.col("score"), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")
