"""What moves and meets in queries that ended at their limits on larger tables."""

import math
import random

import pytest
from test_queries import SF
from test_routing import plain_way, plain_zones

from driftline import plans
from driftline.functions.geo import METRES_PER_DEGREE
from driftline.operators import overlay, routes, spatial, zones
from driftline.sources import readers, sinks
from driftline.streaming import stateful


def plan_of(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_nearest_rows_by_spot(spark):
    rng = random.Random(5)
    spots = [(rng.random() * 0.05, 44 + rng.random() * 0.05) for _ in range(25)] + [(0.0, 44.0), (1.0, 44.0)]
    rows = [(i, i % 2, *rng.choice(spots)) for i in range(200)] + [(200, 0, None, 44.0)]
    df = spark.createDataFrame(rows, "id long, lake long, lon double, lat double")
    got = {(r["l_id"], r["place"]): r["r_id"] for r in spatial.nearest_within(df.filter("id % 3 = 0"), df.filter("id % 3 <> 0"), "id", 4, 2000.0, 45.0, ("lake",)).collect()}
    away = lambda a, b: math.hypot((a[2] - b[2]) * METRES_PER_DEGREE * math.cos(math.radians((a[3] + b[3]) / 2)), (a[3] - b[3]) * METRES_PER_DEGREE)
    wanted = {}
    for a in rows[:200:3]:
        near = sorted((round(away(a, b), 6), b[0]) for b in rows[:200] if b[0] % 3 and b[1] == a[1] and away(a, b) <= 2000)
        wanted |= {(a[0], i + 1): b for i, (_, b) in enumerate(near[:4])}
    assert got == wanted and len({k for k, _ in got}) < 68


def test_spots_ask_for_their_targets_once(spark):
    # rows meet by their spots; pairs of rows, which grow with the square of a spot's, don't appear
    assert plan_of(plans.queries()["join_intent_envelope"](spark, SF)).count("Window") == 0


def test_pairs_of_windows_and_targets_do_not_move(spark):
    plan = plan_of(plans.queries()["alg_snapshot_select"](spark, SF))
    # what is above the join of windows and targets, the last of the plan's upper lines, is no window or sum
    assert "Join" in plan and not {"Window", "Aggregate"} & set(plan[: plan.index("Join")].split())


def test_cells_of_pairs_are_dealt_over_tasks(spark):
    plan = plan_of(plans.queries()["join_self_pairs"](spark, SF), "sparkPlan")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_hulls_move_corners_alone(spark):
    points = spark.range(200_000).selectExpr("id % 2 AS key", "CAST(id % 1000 AS DOUBLE) AS x", "CAST(id DIV 1000 AS DOUBLE) AS y").repartition(4)
    found = overlay.hulls(points)
    assert plan_of(found).count("MapInArrow") == 2 and "FlatMapGroups" not in plan_of(found)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    level = spark.createDataFrame([("k", i, [(x + i / 2, y) for x, y in square]) for i in range(3)], "key string, shape long, ring array<struct<x: double, y: double>>")
    # level sides don't cross each other, so no pairs of them meet
    met = plan_of(overlay._crossings(overlay.edges_of(level), 1.0))
    assert "Aggregate" not in met and {(r["key"], r["n"]) for r in found.collect()} == {(0, 4), (1, 4)} and overlay._crossings(overlay.edges_of(level), 1.0).count() == 0


def test_short_ways_take_no_rounds(spark, monkeypatch):
    rng = random.Random(9)
    open_ = {(area, x, y) for area in (1, 2) for x in range(-45, 40) for y in range(70) if rng.random() < 0.75}
    spots = sorted(open_)
    pairs = [(i, *a, *rng.choice([b for b in spots if b[0] == a[0] and abs(b[1] - a[1]) < 30])[1:]) for i in range(80) for a in [rng.choice(spots)]]
    pairs += [(80, *pairs[0][1:4], *pairs[1][4:]), (81, 1, 500, 0, 510, 0), (82, *spots[0], *spots[0][1:]), (83, 3, 0, 0, 1, 1)]
    monkeypatch.setattr(routes, "_far_ways", None)
    for limit in (20.0, 35.0):
        got = routes.shortest_ways(spark.createDataFrame(spots, "area long, x long, y long"), spark.createDataFrame(pairs, "id int, area long, sx long, sy long, gx long, gy long"), 1.0, limit)
        wanted = {i: plain_way({c[1:] for c in open_ if c[0] == area}, (sx, sy), (gx, gy), limit) for i, area, sx, sy, gx, gy in pairs}
        found = {r["id"]: (r["straight"], r["diagonal"]) for r in got.collect()}
        assert found == wanted and 5 < sum(w[0] is not None for w in wanted.values()) < 84


def test_documents_lie_in_one_folder(spark, tmp_path):
    rows = [("a\nb/", "one\ntwo\n"), ("ü", ""), ("c", None), ("d", "x" * 5000), ("d", "again")]
    sinks.write_documents(spark.createDataFrame(rows, "k string, t string"), "k", "t", str(tmp_path / "docs"))
    assert not [p for p in (tmp_path / "docs").iterdir() if p.is_dir()]
    got = sorted((r["key"], bytes(r["content"]).decode(), r["length"]) for r in readers.stored_documents(spark, str(tmp_path / "docs")).collect())
    assert got == sorted((k, t or "", len(t or "")) for k, t in rows)


def test_batches_are_dealt_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "FILE_ROWS", 40)
    df = spark.range(1000).selectExpr("id * 10 AS at", "id % 7 AS k")
    stream = stateful.replayed_in_order(df, str(tmp_path / "in"), "at", 4)
    seen = []
    see = lambda batch, i: seen.append(batch.selectExpr("min(at)", "max(at)", "count(*)").first())
    stream.writeStream.foreachBatch(see).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(r[2] for r in seen) == 1000 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert len(list((tmp_path / "in").glob("*.parquet"))) in (20, 24)


def batches_of(spark, folder, batches, schema):
    """A stream of one micro-batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def memory(stream, name):
    """What a stream gives, and the most rows of state that it kept."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name), max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])


def test_python_is_called_for_buckets_of_keys(spark, tmp_path):
    rng = random.Random(7)
    keys = [(s, t) for s in (None, 0, 2**53, 2**53 + 1, *range(1, 9)) for t in (None, "", "a", "b")]
    batches = [[(*rng.choice(keys), 10**6 + rng.randrange(200)) for _ in range(300)] for _ in range(3)]
    wanted, last = [], {}
    for rows in batches:
        for s, t, at in sorted(rows, key=lambda r: r[2]):
            if (s, t) not in last or at - last[s, t] >= 60:
                last[s, t] = at
                wanted.append((s, t, at))
    stream = batches_of(spark, str(tmp_path / "in"), batches, "session_id long, trigger string, at long")
    got, held = memory(stateful.with_cooldown(stream, 60, 10**6, buckets=3), "buckets")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    assert len(last) == 48 and held <= 3


def test_keys_of_a_bucket_end_one_by_one(spark, tmp_path):
    # the watermark passes the end of both; the one with a row in that batch goes on, the other one begins anew
    batches = [[(1, 9, 100, 140.0, False), (2, 9, 100, 140.0, None)], [(3, 9, 1000, 500.0, False)], [(1, 9, 1001, 140.0, False)], [(2, 9, 1002, 140.0, False)]]
    stream = batches_of(spark, str(tmp_path / "in"), batches, "session_id long, waypoint_id long, at long, metres double, skipped boolean")
    got, held = memory(stateful.waypoint_states(stream, 50, "0 seconds", buckets=1), "ends")
    assert sorted(map(tuple, got.collect())) == [(1, 9, 100, "NAVIGATING"), (2, 9, 100, "NAVIGATING"), (2, 9, 1002, "NAVIGATING")]
    assert held == 1


@pytest.mark.parametrize("most", [zones.MOST, 40])
def test_groups_are_walked_whole(spark, monkeypatch, most):
    rng = random.Random(3)
    places = [{"id": i, "lake": i % 3 // 2, "weight": 1.0, "area_m2": rng.choice([0.0, 900.0, 60_000.0]), "west": x, "south": y, "east": x, "north": y} for i in range(45) for x, y in [(-79 + rng.random() * 0.02, 44 + rng.random() * 0.02)]]
    away = lambda a, b: round(math.hypot((a["west"] - b["west"]) * 80_000, (a["south"] - b["south"]) * 111_320), -1)
    links = [(away(a, b), a["id"], b["id"], a["lake"]) for a in places for b in places if a["id"] < b["id"] and a["lake"] == b["lake"] and away(a, b) < 500]
    wanted, _ = plain_zones(places, [x[:3] for x in links], zones.Guard())
    if most == zones.MOST:
        monkeypatch.setattr(zones, "grid_cell", None)  # no tiles
    links += [links[0], (10.0, 0, 0, 0), (10.0, 0, 999, 0)]
    rows = spark.createDataFrame([tuple(p.values()) for p in places], "id long, lake long, weight double, area_m2 double, west double, south double, east double, north double")
    got = zones.guarded_zones(rows, spark.createDataFrame(links, "metres double, i long, j long, lake long"), by="lake", most=most)
    assert {r["id"]: r["zone"] for r in got.collect()} == wanted and len(set(wanted.values())) < 40


def test_keys_of_near_rows_move_once(spark):
    df = spark.createDataFrame([(1, 7, 0.0, 44.0), (2, 7, 0.001, 44.0), (3, 8, 0.0, 44.0)], "id long, lake long, lon double, lat double")
    met = spatial.within_radius(df, df, 500.0, 45.0, ("lake",))
    plan = plan_of(met)
    assert "AS r_lake" not in plan[plan.index("Join") :] and met.columns[4:] == ["r_id", "r_lake", "r_lon", "r_lat", "metres"]
    assert sorted((r["l_id"], r["r_id"], r["r_lake"]) for r in met.collect()) == [(1, 1, 7), (1, 2, 7), (2, 1, 7), (2, 2, 7), (3, 3, 8)]
