"""Operators on small tables, against brute force and fixed results."""

import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.functions import geo, planning, scores
from driftline.operators import attribution, candidates, effort, relational, spatial, temporal
from driftline.sources import readers, sinks
from driftline.streaming import stateful


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rates_are_null_without_effort(spark):
    rows = spark.createDataFrame([(4, 3600.0), (4, 0.0)], "n long, s double")
    assert [r[0] for r in rows.select(scores.rate("n", F.col("s") / 3600)).collect()] == [4.0, None]


def test_shrinkage(spark):
    got = spark.createDataFrame([(0, 0.0), (8, 4.0)], "n long, h double").select(*[c.alias(k) for k, c in scores.shrinkage("n", "h").items()]).collect()
    assert (got[0]["score"], got[0]["confidence"]) == (0.5, 0.0)
    assert got[1]["confidence"] == 0.5 and math.isclose(got[1]["score"], 0.5 + 0.5 * (got[1]["raw_score"] - 0.5))


def test_attribution_confidence_falls(spark):
    got = spark.createDataFrame([(0,), (600,), (1200,)], "t long").select(scores.attribution_confidence("t", F.lit(600))).collect()
    assert [round(r[0], 9) for r in got] == [1.0, 0.3, 0.0]


def test_pause_is_cut_out(spark):
    points = spark.createDataFrame([(1, i, t, -79.0, 44.0) for i, t in enumerate((10, 20, 60, 70))], "session_id long, point_id long, at long, lon double, lat double")
    pauses = spark.createDataFrame([(1, 25, 55)], "session_id long, paused long, resumed long")
    found = effort.effort_segments(effort.without_paused(effort.point_pairs(points), pauses))
    assert [(r["kind"], r["seconds"]) for r in found.orderBy("start").collect()] == [("FISHING", 10), ("FISHING", 10)]


def test_long_gap_is_unknown(spark):
    points = spark.createDataFrame([(1, 0, 10, -79.0, 44.0), (1, 1, 310, -79.0, 44.0)], "session_id long, point_id long, at long, lon double, lat double")
    assert values(effort.effort_segments(effort.point_pairs(points)), "kind", "seconds") == [("UNKNOWN", 300)]


def test_same_fish_counts_once(spark):
    rows = [(1, "LOCATION", "FISH_ON", True, 1, 1), (1, "LURE", "FISH_ON", True, 1, 2), (1, "LOCATION", "BITE", True, 2, 3)]
    merged = attribution.merged_outcomes(spark.createDataFrame(rows, "decision_id long, dimension string, outcome string, followed boolean, at long, id long"), ["decision_id", "dimension"])
    assert values(merged, "dimension", "outcome") == [("LOCATION", "FISH_ON"), ("LURE", "FISH_ON")]


def test_upsert_keeps_known_value(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, at long, lake string")
    new = spark.createDataFrame([(1, 6, None), (3, 1, "c")], "k long, at long, lake string")
    assert values(relational.upsert(old, new, ["k"], [F.desc("at")], ("lake",)), "k", "at", "lake") == [(1, 6, "a"), (2, 5, "b"), (3, 1, "c")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 20)), max_size=25))
def test_union_length(spark, intervals):
    rows = spark.createDataFrame([(k, s, s + n) for k, s, n in intervals], "k long, s long, e long")
    wanted = {}
    for k, s, n in intervals:
        wanted.setdefault(k, set()).update(range(s, s + n))
    got = {r["k"]: r["covered"] for r in temporal.union_length(rows, ["k"], "s", "e").collect()}
    assert got == {k: len(v) for k, v in wanted.items() if v}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), max_size=12), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), max_size=12))
def test_as_of(spark, left, right):
    a = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k long, t long, id long")
    b = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k long, u long, rid long")
    got = {r["id"]: r["r_rid"] for r in temporal.as_of(a, b, ["k"], "t", "u", "rid", ["rid"], "r_").collect()}
    assert got == {i: max(((u, j) for j, (kk, u) in enumerate(right) if kk == k and u <= t), default=(0, None))[1] for i, (k, t) in enumerate(left)}


def test_greedy_spacing_is_the_walk(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.1, 0.5, rng.random()]), -79 + rng.random() / 50, 44 + rng.random() / 50) for i in range(150)]
    kept = []
    for i, s, lon, lat in sorted(rows, key=lambda r: (-r[1], r[0])):
        far = lambda q: math.hypot((q[2] - lon) * 111_320 * math.cos(math.radians((q[3] + lat) / 2)), (q[3] - lat) * 111_320) > 200
        if all(far(q) for q in kept):
            kept.append((i, s, lon, lat))
    got = spatial.greedy_spacing(spark.createDataFrame(rows, "id long, score double, lon double, lat double"), "id", "score", 200, 44.1)
    assert values(got, "id") == sorted((k[0],) for k in kept)


def test_trace_keeps_ends_and_anchors(spark):
    rows = [(1, i, i, -79.0 + x, 44.0, a) for i, (x, a) in enumerate([(0, False), (0.00001, False), (0.00002, True), (0.01, False)])]
    got = spatial.thin_trace(spark.createDataFrame(rows, "session_id long, point_id long, at long, lon double, lat double, anchor boolean"), "anchor")
    assert values(got, "point_id") == [(0,), (2,), (3,)]


def test_geojson_and_weather(spark, tmp_path):
    page = {"features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"a": "x"}}], "exceededTransferLimit": True}
    (tmp_path / "p0.json").write_text(json.dumps(page))
    (tmp_path / "p1.json").write_text(json.dumps(page | {"exceededTransferLimit": False}))
    pages = readers.paged_documents(spark, str(tmp_path))
    assert [json.loads(r["coordinates"]) for r in readers.geojson_features(pages).collect()] == [[1.5, 2]] * 2
    assert tuple(readers.pagination_report(pages).first()) == (2, 2, True, False)
    hours = spark.createDataFrame([(1, json.dumps({"hourly": {"time": ["a", "b"], "wind": [1.0, None]}})), (2, "{bad")], "id long, doc string")
    assert sorted(map(tuple, readers.hourly_weather(hours, "doc", ["wind"]).collect()), key=str) == [(1, "a", 1.0), (1, "b", None)]


def run_stream(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def trigger_files(spark, tmp_path):
    # A stream's watermark starts at zero, and what is not after it is late.
    rows = [(1, "a", 100 + t) for t in (0, 5, 10, 14, 20, 31)] + [(2, "a", 107)]
    spark.createDataFrame(rows, "session_id long, trigger string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("session_id long, trigger string, at long").parquet(str(tmp_path / "in"))


def test_cooldown_stream(trigger_files):
    assert values(run_stream(stateful.with_cooldown(trigger_files, 10, 10**6), "cooled"), "session_id", "at") == [(1, 100), (1, 110), (1, 120), (1, 131), (2, 107)]


def test_waypoint_stream(spark, tmp_path):
    # Near, then inside for five samples and 40 seconds, then away; the same with a skip; and too short a stay.
    path = [(1, 200.0), (5, 140.0), (10, 50.0), (20, 55.0), (30, 40.0), (45, 58.0), (50, 59.0), (60, 90.0), (70, 120.0)]
    rows = [(1, 9, t, m, False) for t, m in path] + [(2, 9, t, m, t == 45) for t, m in path if t <= 45] + [(3, 9, t, m, False) for t, m in ((1, 50.0), (10, 50.0), (20, 61.0), (30, 50.0))]
    schema = "session_id long, waypoint_id long, at long, metres double, skipped boolean"
    stream = stateful.replayed(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "in"))
    got = values(run_stream(stateful.waypoint_states(stream, 10**6), "states"), "session_id", "at", "state")
    assert got == [(1, 5, "NAVIGATING"), (1, 45, "ARRIVED"), (1, 45, "FISHING"), (1, 70, "COMPLETED"), (2, 5, "NAVIGATING"), (2, 45, "SKIPPED"), (3, 1, "NAVIGATING")]


def test_latest_rows_and_counts_of_a_stream(spark, tmp_path):
    rows = [(1, 10, "a"), (1, 30, "b"), (2, 5, "c"), (1, 20, "d"), (2, 4000, "e")]
    df = spark.createDataFrame(rows, "k long, at long, v string")
    write = stateful.upsert_latest(str(tmp_path / "latest"), ["k"], "at")
    for i in range(3):
        write(df.filter(f"at <> {[30, 20, 5][i]}"), i)
    assert values(spark.read.parquet(str(tmp_path / "latest" / "version=2")), "k", "v") == [(1, "b"), (2, "e")]
    assert not (tmp_path / "latest" / "version=0").exists()
    counts = stateful.tumbling_counts(df.withColumn("ts", F.timestamp_seconds("at")), "ts", ["k"])
    assert values(counts.withColumn("w", F.unix_seconds("window_start")), "w", "k", "n") == [(0, 1, 3), (0, 2, 1), (3600, 2, 1)]


def test_written_partitions_and_new_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "id long, lake long, v string")
    sinks.write_partitions(table([(1, 1, "a"), (2, 2, "b")]), path, "lake")
    sinks.write_partitions(table([(3, 2, "c")]), path, "lake")
    assert values(spark.read.parquet(path), "id", "lake", "v") == [(1, 1, "a"), (3, 2, "c")]
    plain = str(tmp_path / "p")
    table([(1, 1, "a")]).write.parquet(plain)
    assert values(sinks.append_new(table([(1, 1, "z"), (5, 1, "b"), (5, 2, "a")]), plain, ["id"], F.asc("v")), "id") == [(5,)]
    assert values(spark.read.parquet(plain), "id", "v") == [(1, "a"), (5, "a")]


def test_pages_end_where_they_say(spark):
    page = lambda n, more: json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [i, 0]}, "properties": {}} for i in range(n)], "exceededTransferLimit": more})
    rows = [("a", 0, page(2, True)), ("a", 2, page(1, False)), ("a", 4, page(2, False)), ("b", 0, page(2, True)), ("b", 2, page(2, True)), ("b", 4, page(2, True)), ("c", 0, page(0, False)), ("d", 0, "broken")]
    pages = spark.createDataFrame(rows, "source string, start long, content string")
    got = readers.paged_features(pages, "source", "start", page_size=2, max_pages=2).groupBy("source", "capped").agg(F.count("*").alias("n"))
    assert values(got, "source", "capped", "n") == [("a", False, 3), ("b", True, 4)]


def test_greedy_matches_and_identity(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.1), (3, 3, 0.5), (4, 3, 0.5)], "left long, right long, quality double")
    assert values(candidates.greedy_matches(pairs), "left", "right") == [(1, 1), (2, 2), (3, 3)]
    assert candidates.greedy_matches(pairs.limit(0)).count() == 0
    rows = [(1, 10, 20.0, True, False, False), (1, 11, 1.0, False, True, True), (2, 20, 3.0, False, True, True), (2, 21, 3.01, False, True, True), (3, 30, 16.0, False, True, True), (4, 40, 2.0, False, True, False)]
    found = candidates.resolved_identity(spark.createDataFrame(rows, "lake long, feature_id long, distance_km double, contains boolean, name_match boolean, lake_type boolean"), "lake")
    assert values(found.fillna(-1), "lake", "feature_id", "method") == [(1, 10, "CONTAINS"), (2, -1, "AMBIGUOUS"), (3, -1, "UNRESOLVED"), (4, -1, "UNRESOLVED")]


def test_utm_of_known_places(spark):
    p = spark.createDataFrame([(-79.387139, 43.642567), (3.0, 0.0)], "lon double, lat double")
    u = geo.utm("lon", "lat")
    got = p.select(u["zone"].alias("z"), F.round(u["easting"]).alias("e"), F.round(u["northing"]).alias("n")).collect()
    assert tuple(got[0])[0] == 17 and abs(got[0]["e"] - 630_084) < 2 and abs(got[0]["n"] - 4_833_439) < 2 and tuple(got[1]) == (31, 500_000.0, 0.0)


def test_ring_faults_and_lengths(spark):
    square = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001), (0.0, 0.0)]
    rows = [(0, square), (1, square[:3]), (2, square[:4]), (3, []), (4, [*square[:3], (float("nan"), 0.0)]), (5, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>")
    assert values(df.select("id", F.coalesce(geo.ring_faults("ring"), F.lit("OK")).alias("f")), "f") == sorted([("OK",), ("TOO_SHORT",), ("OPEN",), ("EMPTY",), ("NOT_FINITE",), ("NO_AREA",)])
    one = df.filter("id = 0").select(geo.path_length("ring", 0.0).alias("m"), geo.distance_to_ring(F.lit(0.0005), F.lit(-0.001), "ring", 0.0).alias("d")).first()
    assert abs(one["m"] - 4 * 111.32) < 1e-6 and abs(one["d"] - 111.32) < 1e-6


def test_activity_state_precedence(spark):
    rows = [("FISHING", True, True, "FISHING", "NAVIGATING"), ("UNKNOWN", True, True, None, None), (None, False, True, None, None), (None, False, False, "ARRIVED", "NAVIGATING"), (None, False, False, "COMPLETED", "NAVIGATING"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "o string, p boolean, a boolean, t string, c string")
    found = planning.activity_state("o", "p", "a", "t", "c")
    assert [tuple(r) for r in df.select(found["state"], found["source"]).collect()] == [("FISHING", "OVERRIDE"), ("PAUSED", "SESSION_PAUSE"), ("FISHING", "USER_AD_HOC"), ("FISHING", "PROGRESS"), ("TRANSIT", "PROGRESS"), ("UNKNOWN", "UNKNOWN")]
