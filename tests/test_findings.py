"""Queries on small tables of their own, against their SQL."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_queries import SF, plain
from test_scale import plan_of

from driftline import plans
from driftline.operators import beam

DAY = datetime.datetime(2024, 1, 1)


def events(tmp_path, rows):
    """A folder with ``events`` of (event_id, seconds, user_id, event_type, value, k)."""
    columns = list(zip(*rows))
    props = [f'{{"k": {k}}}' for k in columns[5]]
    times = pa.array([DAY + datetime.timedelta(seconds=s) for s in columns[1]], pa.timestamp("us"))
    ints = lambda c: pa.array(c, pa.int64())
    pq.write_table(pa.table({"event_id": ints(columns[0]), "ts": times, "user_id": ints(columns[2]), "event_type": list(columns[3]), "value": pa.array(columns[4], pa.float64()), "props": props}), tmp_path / "events.parquet")
    return str(tmp_path)


def both(spark, folder, name, *tables):
    """Rows of a query and of its SQL, in the order of the SQL's columns."""
    con = duckdb.connect()
    for t in tables or ("events",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted = con.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    rows = lambda them: sorted(tuple(plain(x) for x in r) for r in them)
    return rows(plans.queries()[name](spark, folder).select(*columns).collect()), rows(wanted.fetchall())


def test_bearings_a_bit_off_a_half_or_whole_turn(spark, tmp_path):
    turns = [(8, 47.52), (11, 51.84), (44, 529.92), (46, 305.28), (50, 0.0), (0, 36.0)]
    got, wanted = both(spark, events(tmp_path, [(i, i, 1, "view", v, k) for i, (k, v) in enumerate(turns)]), "fn_circular")
    assert got == wanted


def test_a_side_run_twice_crosses_twice(spark, tmp_path):
    # (0, 0), (50, 50) and again, then (50, 0) and (0, 50)
    ring = [0, 50, 9700, 9750, 4850, 4900]
    got, wanted = both(spark, events(tmp_path, [(e, i, 1, "view", 1.0, 1) for i, e in enumerate(ring)]), "geo_self_crossing")
    assert got == wanted and int(got[0][-1]) > 1


def test_sessions_end_at_a_gap_of_just_twelve_hours(spark, tmp_path):
    times = [0, 43_199, 86_399, 86_400, 129_599.9, 129_600.2, 200_000]
    got, wanted = both(spark, events(tmp_path, [(i, s, 1, "view", 1.0, 1) for i, s in enumerate(times)]), "stm_session_window")
    assert got == wanted and len(got) == 3


@pytest.mark.parametrize("name", ["join_cross_then_spatial", "agg_case_sum_overlap"])
def test_tracks_meet_the_places_of_their_lake(spark, tmp_path, name):
    # users 1, 6 and 11 share a lake; a track of one passes places of all, and one of length zero lies on a place
    rows = [(0, 0, 1, "view", 99.0, 90), (5, 60, 1, "signup", 1.0, 90), (105, 90, 1, "view", 1.0, 1), (3, 10, 6, "signup", 1.0, 90), (12_003, 500, 11, "signup", 70.0, 1), (9703, 20, 3, "signup", 1.0, 1), (2, 30, 3, "view", 1.0, 1), (2, 30, 3, "view", 1.0, 1)]
    got, wanted = both(spark, events(tmp_path, rows), name)
    place_and_other = ("3", "1") if name == "agg_case_sum_overlap" else ("105", "3")
    assert got == wanted and place_and_other in {r[:2] for r in got}


def test_boxes_apart_have_their_distance(spark, tmp_path):
    rows = [(0, 0, 1, "view", 1.0, 3), (99, 1, 1, "click", 1.0, 3), (1, 2, 1, "click", 1.0, 6), (2, 3, 1, "click", 1.0, 4)]
    got, wanted = both(spark, events(tmp_path, rows), "geo_iou_hausdorff")
    assert got == wanted and [r[:3] for r in got if r[2] == "0"] == [("0", "99", "0")] and len(got) == 2


def test_found_areas_without_overlap_have_none(spark, tmp_path):
    # a small contour in a large one of another depth; session 2 has no nested one
    rows = [(0, 0, 1, "view", 1.0, 3), (9700, 1, 1, "view", 9.0, 20), (99, 2, 1, "click", 1.0, 0), (1, 3, 1, "click", 1.0, 3), (2, 4, 2, "click", 1.0, 1)]
    got, wanted = both(spark, events(tmp_path, rows), "alg_hybrid_validate")
    assert got == wanted and [r[1] for r in got if r[0] in ("2", "99")] == ["None", "0"]


def test_steps_of_a_route_do_not_move_again(spark):
    trips = spark.createDataFrame([(1, 1, 0, 0, 0, 9000, 0)], "trip long, area long, x long, y long, start long, end long, reserve long")
    options = spark.createDataFrame([(1, i, 200 * i, 0, 100 + i) for i in range(1, 4)], "area long, option long, x long, y long, worth long")
    steps = beam.expanded(beam._start(trips), trips, options, beam.Plan())
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    layer = beam._beam(steps.filter("reason IS NULL"), 6)
    assert moves(layer) == moves(steps) and moves(steps.groupBy("area", "trip", "reason").count()) == moves(steps)
    assert [(r["reached"], len(r["states"])) for r in layer.collect()] == [(12, 6)]


def test_launches_take_no_more_rows_than_they_keep(spark):
    found = plans.queries()["alg_launch_recommend"](spark, SF)
    # the choice among candidates comes before the join with launches, and once more behind it
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Filter (_rn") > plan.index("Join Inner")


def test_forecasts_are_looked_up_once_for_each_time(spark):
    trips = spark.createDataFrame([(1, 1, 0, 0, 0, 9000, 0)], "trip long, area long, x long, y long, start long, end long, reserve long")
    options = spark.createDataFrame([(1, i, 200 * i, 0, 100 + i, 1) for i in range(1, 4)], "area long, option long, x long, y long, worth long, likes long")
    hours = spark.createDataFrame([(1, 0, 100, 0), (1, 1800, 300, 50), (1, 1800, 200, 50), (1, 5400, 200, 0)], "area long, at long, wind long, light long")
    steps = beam.expanded(beam._start(trips), trips, options, beam.Plan(), beam.by_area(hours), beam.Weather())
    # three slots and two times of the way, for each wait; the filter of a lookup was copied to each of its uses
    assert plan_of(steps).count("filter(") == 10
    assert steps.filter("reason IS NULL").count() == 12


def test_lengths_are_rounded_as_numbers(spark):
    lengths = spark.range(1).select(beam._metres(*map(F.lit, (0, 0, 3, 2))).alias("a"), beam._metres(*map(F.lit, (5, 5, 4, 4))).alias("b"), beam._metres(*map(F.lit, (0, 0, 0, 0))).alias("c"))
    assert lengths.dtypes == [(c, "bigint") for c in "abc"] and tuple(lengths.first()) == (4, 1, 0) and "round(" not in plan_of(lengths)


@pytest.mark.parametrize("name", ["join_cross_then_spatial", "agg_case_sum_overlap"])
def test_places_of_one_spot_meet_a_track_once(spark, tmp_path, name):
    rng = random.Random(4)
    kinds = ["signup", "view", "click"]
    # ids 9700 apart lie on one spot
    rows = [(rng.randrange(300) * 31 + 9700 * copy * 7, rng.randrange(90_000), rng.randrange(12), rng.choice(kinds), 1.0, 1) for copy in range(3) for _ in range(120)]
    folder = events(tmp_path, sorted({r[0]: r for r in rows}.values()))
    got, wanted = both(spark, folder, name)
    assert got == wanted and len(got) > 200
    plan = plan_of(plans.queries()[name](spark, folder))
    # places come out of their spots above the join, and no share is rounded by way of its decimal text
    assert plan.index("explode(place_ids") < plan.index("Join Inner") and "round(share" not in plan and "round(sum" not in plan


def test_shares_are_summed_where_pairs_are_met(spark, tmp_path):
    found = plans.queries()["agg_case_sum_overlap"](spark, events(tmp_path, [(i, i, 1, "signup", 1.0, 1) for i in range(9)]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]


def test_bearings_are_exact_multiples(spark, tmp_path):
    # (k, hundredths) of turns that came out on the other side of a half or a whole turn while k * 7.2 was a product of doubles
    turns = [(84, 15_696), (94, 17_136), (72, 6_768), (52, 25_488), (94, 45_936), (1, 78_768), (1, 85_968), (92, 9_648)]
    got, wanted = both(spark, events(tmp_path, [(v * 100 + k, i, 1, "view", v / 100, k) for i, (k, v) in enumerate(turns)]), "fn_circular")
    assert got == wanted


def test_spacings_of_pairs_are_rounded_as_numbers(spark):
    # pairs are many times the rows; rounding each through its decimal text took half the time
    assert "round(" not in plan_of(plans.queries()["join_self_pairs"](spark, SF))
