"""Zones: agglomeration along links in order, each merge guarded by what the zone would become."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import METRES_PER_DEGREE, grid_cell
from driftline.operators.lineage import written

#: Links of a tile that one task walks; fuller tiles settle their first links alone.
MOST = 20_000
_STATE = ("weight", "area_m2", "west", "south", "east", "north", "gap")


@dataclass(frozen=True)
class Guard:
    """What a zone may be: its span, its widest link, its weight for its area, and its span for the root of its area."""

    # Fixed values.
    max_span_m: float = 900.0
    max_gap_m: float = 450.0
    min_per_km2: float = 6.0
    max_stretch: float = 8.0

    def refuses(self, zone: dict) -> str | None:
        """The first reason against a zone."""
        high, wide = zone["north"] - zone["south"], zone["east"] - zone["west"]
        box = math.hypot(high * METRES_PER_DEGREE, wide * METRES_PER_DEGREE * math.cos(math.radians((zone["south"] + zone["north"]) / 2)))
        span = max(box, longest_way(zone["ways"]))
        if span > self.max_span_m:
            return "SPAN"
        if zone["gap"] > self.max_gap_m:
            return "GAP"
        if zone["weight"] / max(zone["area_m2"] / 1e6, 1e-6) < self.min_per_km2:
            return "DENSITY"
        return "STRETCH" if zone["area_m2"] > 1 and span / math.sqrt(zone["area_m2"]) > self.max_stretch else None


def _farthest(start: int, near: dict[int, list[tuple[int, int]]]) -> tuple[int, int]:
    far, best, todo = {start: 0}, (0, start), [start]
    for node in todo:
        best = max(best, (far[node], node))
        for other, metres in near.get(node, ()):
            if other not in far:
                far[other] = far[node] + metres
                todo.append(other)
    return best


def longest_way(ways: list[dict]) -> int:
    """Length of the longest way in a tree of links of whole metres."""
    near: dict[int, list[tuple[int, int]]] = {}
    for w in ways:
        near.setdefault(w["i"], []).append((w["j"], w["m"]))
        near.setdefault(w["j"], []).append((w["i"], w["m"]))
    return _farthest(_farthest(ways[0]["i"], near)[1], near)[0] if ways else 0


def joined(a: dict, b: dict, link: dict) -> dict:
    """The zone that a link makes of two."""
    pick = {"weight": float.__add__, "area_m2": float.__add__, "west": min, "south": min, "east": max, "north": max}
    return {k: f(a[k], b[k]) for k, f in pick.items()} | {"gap": max(a["gap"], b["gap"], link["metres"]), "ways": [*a["ways"], *b["ways"], {"i": link["i"], "j": link["j"], "m": math.floor(link["metres"] + 0.5)}]}


def walked(links: list[dict], zones: dict[int, dict], guard: Guard) -> tuple[list[dict], dict[int, int]]:
    """Links that are settled, and the zone that each zone has become, by a walk over links in order; ``zones`` is updated.

    A link to a zone that is not here holds up its own zone: what comes later
    there, and whatever meets it, waits.
    """
    into = {z: z for z in zones}

    def root(zone: int) -> int:
        while into[zone] != zone:
            into[zone] = into[into[zone]]
            zone = into[zone]
        return zone

    settled, waits = [], set()
    for link in links:
        ends = [root(z) if z in into else None for z in (link["a"], link["b"])]
        if ends[0] is not None and ends[0] == ends[1]:
            settled.append(link)
        elif None in ends or not waits.isdisjoint(ends):
            waits.update(e for e in ends if e is not None)
        else:
            settled.append(link)
            zone = joined(zones[ends[0]], zones[ends[1]], link)
            if not guard.refuses(zone):
                keep, gone = sorted(ends)
                zones[keep], into[gone] = zone, keep
    return settled, {z: root(z) for z in into}


def _walk_tasks(guard: Guard):
    empty = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("metres", pa.float64()), ("zone", pa.int64()), ("keep", pa.int64()), *((c, pa.float64()) for c in _STATE), ("ways", pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("m", pa.int64())])))])

    def run(links: pa.Table, zones: pa.Table) -> pa.Table:
        them = {z.pop("zone"): z for z in zones.drop_columns(["task"]).to_pylist()}
        before = dict(them)
        settled, into = walked(sorted(links.to_pylist(), key=lambda x: (x["metres"], x["i"], x["j"])), them, guard)
        rows = [{"i": s["i"], "j": s["j"], "metres": s["metres"]} for s in settled]
        rows += [{"zone": z, "keep": k} for z, k in into.items() if z != k]
        rows += [{"zone": z, **{c: them[z][c] for c in (*_STATE, "ways")}} for z, k in into.items() if z == k and them[z] is not before[z]]
        return pa.Table.from_pylist(rows, empty)

    return run


def _whole_walks(guard: Guard):
    """Zones of groups whose links and places are all there."""

    def run(links: pa.Table, places: pa.Table) -> pa.Table:
        zones = {p["id"]: {c: p[c] for c in _STATE[:-1]} | {"gap": 0.0, "ways": []} for p in places.to_pylist()}
        there = {(x["metres"], x["i"], x["j"]) for x in links.to_pylist() if x["i"] in zones and x["j"] in zones}
        _, into = walked([{"i": i, "j": j, "metres": m, "a": i, "b": j} for m, i, j in sorted(there)], zones, guard)
        return pa.table({"id": pa.array(list(into), pa.int64()), "zone": pa.array(list(into.values()), pa.int64())})

    return run


def guarded_zones(places: DataFrame, links: DataFrame, guard: Guard = Guard(), by: str | None = None, most: int = MOST) -> DataFrame:
    """(id, zone) of every place: the least id of the zone that a walk over the links leaves it in.

    ``places``: id, weight, area_m2, west, south, east, north. ``links``: i, j,
    metres, walked by metres, then i, then j. A link joins the zones of its ends
    unless the guard refuses the joined one; a refused link is not tried again.
    The span of a zone is the longest way over its links, in rounded metres, or
    its box's diagonal.

    The outcome of a link depends on the links before it at its two zones
    alone, so walks in different places don't wait for each other: zones are
    dealt into tiles by where they are, and each tile is walked as far as links
    to other tiles allow. Tiles shift by half a side from round to round, and a
    side is so long that two zones a link apart share a tile in one of four
    rounds. In a tile with more than ``most`` links only those that are the
    first of both their zones are settled, each in a task of its own. So the
    result is the walk's, and no task holds more than a tile or two zones.

    If ``by`` is given and ``links`` have it too, no link may join places of
    different ones. Groups of at most ``most`` links are then walked whole, in a
    task each, and the others alone go in rounds.
    """
    if by and by in links.columns:
        fit = lambda df: df.select("id", F.col(by).alias("by"), *[F.col(c).cast("double").alias(c) for c in _STATE[:-1]])
        known = written(links.select("i", "j", F.col("metres").cast("double").alias("metres"), F.col(by).alias("by")).filter("i <> j").dropna(subset=["i", "j", "metres"]).filter(F.col("metres") <= guard.max_gap_m))
        crowded = written(known.groupBy("by").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("by"))
        own = fit(places)
        alone = own.join(crowded, "by", "left_anti")
        whole = known.join(crowded, "by", "left_anti").groupBy("by").cogroup(alone.groupBy("by")).applyInArrow(_whole_walks(guard), "id long, zone long")
        if crowded.isEmpty():
            return whole
        return whole.unionByName(guarded_zones(own.join(crowded, "by", "left_semi"), known.join(crowded, "by", "left_semi").drop("by"), guard, "by", most))
    side = 2 * (2 * guard.max_span_m + guard.max_gap_m)
    zones = written(places.select(F.col("id").alias("zone"), *[F.col(c).cast("double").alias(c) for c in _STATE[:-1]], F.lit(0.0).alias("gap"), F.expr("cast(array() as array<struct<i: bigint, j: bigint, m: bigint>>)").alias("ways")))
    member = places.select("id", F.col("id").alias("zone"))
    apart = places.select(F.col("id").alias("zone"), (F.col(by) if by else F.lit(0)).alias("by"))
    ids = places.select("id")
    # a link that is too long is refused whenever it comes; one of a place to itself, or to none, joins nothing
    left = links.select("i", "j", F.col("metres").cast("double").alias("metres")).filter("i <> j").dropna().filter(F.col("metres") <= guard.max_gap_m).distinct()
    left = left.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi")
    left = written(left.select("i", "j", "metres", F.col("i").alias("a"), F.col("j").alias("b")))
    order, turn = F.struct("metres", "i", "j"), 0
    schema = "i long, j long, metres double, zone long, keep long, " + ", ".join(f"{c} double" for c in _STATE) + ", ways array<struct<i: long, j: long, m: long>>"
    # columns of tiles are as wide as the farthest zones ask for
    farthest = places.agg(F.max(F.greatest(F.abs("south"), F.abs("north")))).first()[0]
    while not left.isEmpty():
        lon, lat = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
        half = side / 2 / METRES_PER_DEGREE
        x, y = grid_cell(lon + (half / math.cos(math.radians(farthest)) if turn & 1 else 0.0), lat + (half if turn & 2 else 0.0), side, farthest)
        tiles = written(zones.join(apart, "zone").select("zone", F.concat_ws(":", "by", x, y).alias("task")))
        ends = left.select("i", "j", "metres", "a", "b", F.explode(F.array("a", "b")).alias("zone")).join(tiles, "zone")
        crowded = written(ends.groupBy("task").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("task"))
        walks, held = ends.select("task", "i", "j", "metres", "a", "b").distinct(), tiles
        if not crowded.isEmpty():
            first = left.select(F.explode(F.array("a", "b")).alias("zone"), order.alias("link")).groupBy("zone").agg(F.min("link").alias("link"))
            of = lambda s: first.select(F.col("zone").alias(s), F.col("link").alias(f"first_{s}"))  # noqa: B023, E731
            tops = left.join(of("a"), "a").join(of("b"), "b").filter((order == F.col("first_a")) & (order == F.col("first_b")))
            inside = ends.join(crowded, "task", "left_semi").select("i", "j", "metres").distinct()
            tops = written(tops.join(inside, ["i", "j", "metres"]).select(F.concat_ws("-", "i", "j").alias("task"), "i", "j", "metres", "a", "b"))
            walks = walks.join(crowded, "task", "left_anti").unionByName(tops)
            held = tiles.join(crowded, "task", "left_anti").unionByName(tops.select(F.explode(F.array("a", "b")).alias("zone"), "task"))
        states = held.join(zones, "zone").select(F.concat("task", F.lit("")).alias("task"), "zone", *_STATE, "ways")
        out = written(walks.groupBy("task").cogroup(states.groupBy("task")).applyInArrow(_walk_tasks(guard), schema))
        settled, moved, grown = out.filter("i IS NOT NULL").select("i", "j", "metres"), out.filter("keep IS NOT NULL").select(F.col("zone").alias("was"), "keep"), out.filter("weight IS NOT NULL").select("zone", *_STATE, "ways")
        rename = lambda df, c: df.join(moved.withColumnRenamed("was", c), c, "left").withColumn(c, F.coalesce("keep", c)).drop("keep")  # noqa: B023, E731
        todo = left.join(settled, ["i", "j", "metres"], "left_anti")
        left = written(rename(rename(todo, "a"), "b").filter("a <> b").select("i", "j", "metres", "a", "b"))
        gone = moved.select(F.col("was").alias("zone")).unionByName(grown.select("zone"))
        zones = written(zones.join(gone, "zone", "left_anti").unionByName(grown))
        member, turn = written(rename(member, "zone").select("id", "zone")), turn + 1
    return member
