"""Ways, zones and choices of routes against walks in plain Python."""

import heapq
import math
import random

import pytest

from driftline.operators import routes, zones
from driftline.operators.graph import connected


def plain_way(cells, start, goal, limit):
    best, queue = {start: (0.0, 0, 0)}, [(0.0, 0, 0, start)]
    while queue and start in cells:
        _, a, b, (x, y) = heapq.heappop(queue)
        if (x, y) == goal:
            return a, b
        for dx, dy in routes.MOVES:
            to, way = (x + dx, y + dy), (a + (not (dx and dy)), b + bool(dx and dy))
            beside = not (dx and dy) or ((x + dx, y) in cells and (x, y + dy) in cells)
            length = way[0] + way[1] * math.sqrt(2)
            if to in cells and beside and length <= limit and length < best.get(to, (math.inf,))[0]:
                best[to] = (length, *way)
                heapq.heappush(queue, (length, *way, to))
    return None, None


def test_ways_across_tiles(spark):
    rng = random.Random(4)
    open_ = {(area, x, y) for area in "pq" for x in range(-40, 60) for y in range(0, 80) if rng.random() < 0.72 and not (x == 10 and y > 3)}
    open_ |= {("r", x, 0) for x in range(300)} | {("r", 299, y) for y in range(50)}
    spots = sorted(c for c in open_ if c[0] != "r")
    pairs = [(i, *a, *b[1:], "x") for i in range(60) for a, b in [(rng.choice(spots), rng.choice(spots))]]
    pairs += [(100, "r", 0, 0, 299, 49, "y"), (101, "r", 0, 0, 0, 0, "y"), (102, "r", 0, 0, 500, 500, "y"), (103, "none", 0, 0, 1, 1, "y"), (104, None, 0, 0, 1, 1, "y"), (105, "r", None, 0, 1, 1, "y"), pairs[0]]
    cells = spark.createDataFrame([*open_, ("r", 0, 0), (None, 1, 1), ("r", None, 1)], "area string, x int, y int")
    got = routes.shortest_ways(cells, spark.createDataFrame(pairs, "id int, area string, sx int, sy int, gx int, gy int, moves string"), 10.0, 1500.0).collect()
    assert len(got) == len(pairs)
    known = {r["id"]: r for r in got}
    for i, area, sx, sy, gx, gy, _ in pairs:
        wanted = (None, None)
        if (area, sx, sy) in open_ and (area, gx, gy) in open_:
            wanted = plain_way({c[1:] for c in open_ if c[0] == area}, (sx, sy), (gx, gy), 150.0)
        assert (known[i]["straight"], known[i]["diagonal"]) == wanted, i
        assert known[i]["metres"] is None if wanted[0] is None else math.isclose(known[i]["metres"], 10 * (wanted[0] + wanted[1] * math.sqrt(2)))
    assert known[101]["metres"] == 0 and known[100]["metres"] is None  # 348 steps are over the cut-off
    assert sum(r["metres"] is not None for r in got) > 15 and sum(r["metres"] is None for r in got) > 10
    far = routes.shortest_ways(cells, spark.createDataFrame(pairs[60:61], "id int, area string, sx int, sy int, gx int, gy int, moves string"), 10.0, 5000.0).first()
    assert (far["straight"], far["diagonal"]) == (348, 0)
    assert routes.shortest_ways(cells.limit(0), spark.createDataFrame(pairs[:1], "id int, area string, sx int, sy int, gx int, gy int, moves string"), 10.0, 1500.0).first()["metres"] is None


def test_components_are_the_least_vertex(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(80)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_zones(places, links, guard):
    """The walk, one link after another; distances inside zones by all pairs."""
    zone = {p["id"]: p["id"] for p in places}
    at, far, gap, refused = {p["id"]: p for p in places}, {(p["id"], p["id"]): 0 for p in places}, dict.fromkeys(zone, 0.0), []
    for m, i, j in sorted(set(links)):
        if i == j or i not in zone or j not in zone or zone[i] == zone[j]:
            continue
        a, b = ([p for p in zone if zone[p] == zone[x]] for x in (i, j))
        way = {(p, q): far[p, i] + math.floor(m + 0.5) + far[j, q] for p in a for q in b}
        them = [at[p] for p in a + b]
        low, high = min(p["south"] for p in them), max(p["north"] for p in them)
        wide = max(p["east"] for p in them) - min(p["west"] for p in them)
        span = max(*way.values(), *(far[p, q] for s in (a, b) for p in s for q in s), math.hypot((high - low) * 111320, wide * 111320 * math.cos(math.radians((low + high) / 2))))
        area, weight = sum(p["area_m2"] for p in them), sum(p["weight"] for p in them)
        widest = max(m, gap[zone[i]], gap[zone[j]])
        why = "SPAN" if span > guard.max_span_m else "GAP" if widest > guard.max_gap_m else "DENSITY" if weight / max(area / 1e6, 1e-6) < guard.min_per_km2 else "STRETCH" if area > 1 and span / math.sqrt(area) > guard.max_stretch else None
        if why:
            refused.append(why)
            continue
        far |= way | {(q, p): d for (p, q), d in way.items()}
        keep = min(zone[i], zone[j])
        for p in a + b:
            zone[p] = keep
        gap[keep] = widest
    return zone, refused


@pytest.mark.parametrize("most, n", [(zones.MOST, 500), (12, 40)])
def test_zones_are_those_of_the_walk(spark, most, n):
    rng = random.Random(8)
    places = []
    for i in range(n):
        # dense places and sparse ones, far over several tiles, some of them on one point
        lon, lat = (-79 + rng.random() * 0.02, 44 + rng.random() * 0.02) if i < n * 0.4 else (-79 + rng.random() * 0.2, 44 + rng.random() * 0.2) if i < n * 0.9 else (-78.5, 44.5)
        places.append({"id": i, "weight": rng.choice([1.0, 2.5]), "area_m2": rng.choice([0.0, 900.0, 20_000.0, 60_000.0, 500_000.0]), "west": lon, "south": lat, "east": lon + rng.choice([0, 0.001]), "north": lat})
    away = lambda a, b: math.hypot((a["west"] - b["west"]) * 80_000, (a["south"] - b["south"]) * 111_320)
    links = [(float(round(away(a, b), -1)), a["id"], b["id"]) for a in places for b in places if a["id"] < b["id"] and away(a, b) < 500]  # tens of metres, so many ties
    links += [(10.0, 3, 3), (10.0, 3, 9999), links[0], (5.0, links[0][2], links[0][1])]
    wanted, refused = plain_zones(places, links, zones.Guard())
    assert n < 500 or ({"SPAN", "GAP", "DENSITY", "STRETCH"} == set(refused) and len(set(wanted.values())) < 450)
    cells = spark.createDataFrame([(p["id"], p["weight"], p["area_m2"], p["west"], p["south"], p["east"], p["north"]) for p in places], "id long, weight double, area_m2 double, west double, south double, east double, north double")
    got = zones.guarded_zones(cells, spark.createDataFrame([(i, j, m) for m, i, j in links] + [(None, 1, 1.0), (1, 2, None)], "i long, j long, metres double"), most=most)
    assert {r["id"]: r["zone"] for r in got.collect()} == wanted
    assert zones.guarded_zones(cells.limit(0), spark.createDataFrame([], "i long, j long, metres double")).count() == 0
