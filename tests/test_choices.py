"""Route search, visits and joins of boxes and lines against plain walks."""

import math
import random

import pytest

from driftline.operators import beam, candidates, overlay, subplans


WEATHER = beam.Weather()


def order(state):
    return (-state[7], state[4], state[5], state[1])


def plain_value(hours, time, field):
    """A forecast's field (1: wind, 2: light) at a time; None without one."""
    low = max((h for h in hours if h[0] <= time), default=None)
    high = min((h for h in hours if h[0] > time), default=None)
    low, high = low or high, high or low
    if low is None or low[field] is None or high[field] is None:
        return None
    return low[field] + math.floor((high[field] - low[field]) * (time - low[0]) / max(1, high[0] - low[0]))


def plain_had(worth, likes, arrive, dwell, plan, hours):
    if hours is None:
        return worth * dwell // (dwell + plan.half)
    total = 0
    for slot, share in enumerate((1000, 850, 722)[: -(-dwell // 900)]):
        wind, light = (plain_value(hours, arrive + slot * 900, field) for field in (1, 2))
        blown = 0 if wind is None else min(1000, max(0, math.floor((wind - 200) * 1000 / 200)))
        total += min(1500, max(0, worth + likes * (light or 0) - blown)) * share // 1000
    return total


def plain_layer(states, trip, options, plan, hours):
    """The beam behind a layer."""
    _, area, hx, hy, _, end, reserve = trip
    far = lambda a, b, c, d: round(math.hypot(a - c, b - d))
    made = []
    for stops, path, x, y, time, used, waited, value in states:
        for place, option, ox, oy, worth, likes in options:
            for wait in plan.waits:
                for dwell in plan.dwells:
                    leg, home = far(x, y, ox, oy), far(ox, oy, hx, hy)
                    depart, arrive = time + wait, time + wait + leg // plan.speed
                    leave = arrive + dwell
                    if place != area or any(s[0] == option or far(s[2], s[3], ox, oy) < plan.spacing for s in stops) or waited + wait > plan.max_wait or leg > plan.max_leg:
                        continue
                    if leave + home // plan.speed + reserve > end or used + leg + home > plan.max_range:
                        continue
                    if any((plain_value(hours or [], t, 1) or 0) >= 400 for t in (depart, (depart + arrive) // 2, arrive)):
                        continue
                    gain = plain_had(worth, likes, arrive, dwell, plan, hours) - leg * plan.leg_cost // 100 - wait * plan.wait_cost // 60
                    state = (f"{path}>{option}:{wait}:{dwell}" if path else f"{option}:{wait}:{dwell}", ox, oy, leave, used + leg, waited + wait, value + gain)
                    made.append(((*stops, (option, *state)), *state))
    alike = lambda a, b: a[2:4] == b[2:4] and sorted(s[0] for s in a[0]) == sorted(s[0] for s in b[0])
    beaten = lambda b: any(alike(a, b) and a[4] <= b[4] and a[5] <= b[5] and a[7] >= b[7] and (a[4], a[5], a[7]) != (b[4], b[5], b[7]) for a in made)
    return sorted((b for b in made if not beaten(b)), key=order)[: plan.width]


def plain_start(trip):
    return ((), "", trip[2], trip[3], trip[4], 0, 0, 0)


def plain_route(done):
    best = min(done, key=order, default=None)
    return (best[1], len(best[0]), best[4], best[5], best[7]) if best else (None, 0, None, None, None)


def plain_search(trips, options, plan, hours=None):
    routes = {}
    for trip in trips:
        states, done = [plain_start(trip)], []
        for layer in range(1, plan.max_stops + 1):
            states = plain_layer(states, trip, options, plan, None if hours is None else [h[1:] for h in hours if h[0] == trip[1]])
            done += states if layer >= plan.min_stops else []
        routes[trip[0]] = plain_route(done)
    return routes


def plain_rolling(trips, options, plan, ahead, settle, hours=None):
    routes = {}
    for trip in trips:
        settled, done = plain_start(trip), []
        for before in range(0, plan.max_stops, settle):
            states, window = [settled], []
            for _ in range(min(ahead, plan.max_stops - before)):
                states = plain_layer(states, trip, options, plan, None if hours is None else [h[1:] for h in hours if h[0] == trip[1]])
                window += states
            if not window:
                break
            stops = min(window, key=order)[0][: before + settle]
            settled = (stops, *stops[-1][1:])
            done += [settled] if len(stops) >= plan.min_stops else []
        routes[trip[0]] = plain_route(done)
    return routes


def some_trips(spark):
    """Trips, options and forecasts; area 3 has no options, area 2 no forecast, and area 1 hours without wind."""
    rng = random.Random(7)
    options = [(area, area * 100 + i, rng.randrange(0, 2500, 25), rng.randrange(0, 2500, 25), rng.randrange(100, 1000)) for area in range(3) for i in range(7)]
    trips = [(t, t % 4, rng.randrange(0, 2500, 25), rng.randrange(0, 2500, 25), 0, rng.choice([600, 4000, 9000]), 300) for t in range(12)]
    options = [(*o, rng.choice([-1, 0, 1])) for o in options]
    winds = [(0, at, rng.choice([50, 250, 380, 450]), rng.randrange(500)) for at in (-900, 300, 2000, 5000)] + [(1, 0, None, 100), (1, 4000, 390, None), (1, 6000, 300, 700), (3, 0, 900, 0), (None, 0, 900, 0), (0, None, 900, 0)]
    frames = (
        spark.createDataFrame(trips, "trip long, area long, x long, y long, start long, end long, reserve long"), spark.createDataFrame(options, "area long, option long, x long, y long, worth long, likes long"),
        spark.createDataFrame(winds, "area long, at long, wind long, light long"),
    )
    return trips, options, [w for w in winds if w[1] is not None], frames


def routes_of(found):
    return {r["trip"]: (r["path"], r["stops"], r["time"], r["used"], r["value"]) for r in found.collect()}


def test_routes_are_those_of_the_plain_search(spark):
    trips, options, _, (trip_rows, option_rows, _) = some_trips(spark)
    plan = beam.Plan(min_stops=2, width=4)
    found = beam.search(trip_rows, option_rows.drop("likes"), plan)
    got = routes_of(found.routes)
    assert got == plain_search(trips, options, plan) and sum(r[1] > 0 for r in got.values()) >= 4
    layers = found.layers.collect()
    assert all(r["kept"] <= min(r["left"], 4) and r["left"] <= r["reached"] for r in layers) and {r["layer"] for r in layers} == {1, 2, 3}
    assert {r["reason"] for r in found.rejects.collect()} <= set(beam.REASONS)


def test_forecasts_change_routes_as_in_the_plain_search(spark):
    trips, options, hours, (trip_rows, option_rows, hour_rows) = some_trips(spark)
    plan = beam.Plan(width=4)
    found = beam.search(trip_rows, option_rows, plan, hour_rows, WEATHER)
    wanted = plain_search(trips, options, plan, hours)
    assert routes_of(found.routes) == wanted != plain_search(trips, options, plan)
    assert "WIND" in {r["reason"] for r in found.rejects.collect()}
    calm = beam.search(trip_rows, option_rows, plan, hour_rows.limit(0), WEATHER)
    assert routes_of(calm.routes) == plain_search(trips, options, plan, [])


def test_rolling_windows_are_those_of_the_plain_walk(spark):
    trips, options, hours, (trip_rows, option_rows, hour_rows) = some_trips(spark)
    plan = beam.Plan(max_stops=4, width=3)
    for ahead, settle, under in ((1, 1, None), (2, 1, hours), (3, 2, None)):
        found = beam.rolling(trip_rows, option_rows, plan, ahead, settle, under and hour_rows, WEATHER)
        assert routes_of(found) == plain_rolling(trips, options, plan, ahead, settle, under)
    assert routes_of(beam.rolling(trip_rows.limit(0), option_rows, plan)) == {}
    with pytest.raises(ValueError, match="far ahead"):
        beam.rolling(trip_rows, option_rows, plan, 1, 2)


def test_visits_are_those_of_the_plain_walk(spark):
    rng = random.Random(3)
    visit = subplans.Visit(budgets=(10, 30, 60), pace=100)
    zones = [(z, (0, 0), (rng.randrange(900), 0), [(10 * z + i, rng.randrange(1500), rng.randrange(1500), rng.randrange(0, 900)) for i in range(rng.randrange(0, 8))]) for z in range(20)]
    schema = "zone long, entry struct<x: long, y: long>, exit struct<x: long, y: long>, members array<struct<member: long, x: long, y: long, worth: long>>"
    got = sorted((r["zone"], r["budget"], list(r["stops"]), r["fishing"], r["transit"], r["metres"], r["utility"]) for r in subplans.packages(spark.createDataFrame(zones, schema), visit).collect())
    wanted = []
    for zone, entry, out, members in zones:
        made = []
        for budget in visit.budgets:
            at, left, stops, fishing, transit, metres, utility = entry, budget, [], 0, 0, 0, 0
            while True:
                offers = []
                for place, (m, x, y, worth) in enumerate(members):
                    way = round(math.hypot(x - at[0], y - at[1]))
                    hop = max(1, math.floor(way / 100 + 0.5))
                    dwell = min(20, left - hop)
                    if dwell >= 8 and m not in stops:
                        offers.append((worth * dwell // 20 - 20 * hop, -place, hop, dwell, way, m, (x, y)))
                if not offers:
                    break
                score, _, hop, dwell, way, m, at = max(offers)
                left, fishing, transit, metres, utility = left - hop - dwell, fishing + dwell, transit + hop, metres + way, utility + max(0, score)
                stops.append(m)
            way = round(math.hypot(at[0] - out[0], at[1] - out[1]))
            if math.floor(way / 100 + 0.5) <= left and fishing:
                made.append((zone, budget, stops, fishing, transit + math.floor(way / 100 + 0.5), metres + way, utility))
        wanted += [b for b in made if not any(a[1] <= b[1] and a[6] >= b[6] and (a[1], a[6]) != (b[1], b[6]) for a in made)]
    assert got == sorted(wanted) and len(got) >= 5


def test_boxes_meet_once(spark):
    rng = random.Random(5)
    boxes = [(i, i % 2, (x, y, x + rng.random() * 0.2, y + rng.random() * 0.2)) for i in range(120) for x, y in [(rng.uniform(-1, 1), rng.uniform(-1, 1))]]
    made = lambda name, id_: spark.createDataFrame([(k, i, b) for i, k, b in boxes], f"k long, {id_} long, {name} struct<west: double, south: double, east: double, north: double>")
    got = [(r["i"], r["j"]) for r in candidates.near_boxes(made("a", "i"), made("b", "j"), ["k"], "a", "b", 0.03).collect()]
    near = lambda a, b: a[0] - 0.03 <= b[2] and a[2] + 0.03 >= b[0] and a[1] - 0.03 <= b[3] and a[3] + 0.03 >= b[1]
    assert sorted(got) == sorted((i, j) for i, k, a in boxes for j, m, b in boxes if k == m and near(a, b))


def test_lines_merge_where_two_meet(spark):
    lines = [(1, 0, 0, 1, 0), (2, 2, 0, 1, 0), (3, 2, 0, 3, 0), (4, 3, 0, 3, 1), (5, 3, 0, 4, 0), (6, 9, 9, 8, 8), (7, 8, 8, 7, 9), (8, 7, 9, 9, 9), (9, 5, 5, 5, 5)]
    got = {r["line_id"]: (r["merged_id"], r["closed"]) for r in overlay.merged_lines(spark.createDataFrame(lines, "line_id long, ax long, ay long, bx long, by long")).collect()}
    # three lines end at (3, 0); a ring and a line back to its own start are closed
    assert got == {1: (1, False), 2: (1, False), 3: (1, False), 4: (4, False), 5: (5, False), 6: (6, True), 7: (6, True), 8: (6, True), 9: (9, True)}


def test_crossings_of_rings(spark):
    rings = [("bow", [(0, 0), (4, 4), (4, 0), (0, 4)]), ("square", [(0, 0), (4, 0), (4, 4), (0, 4)]), ("star", [(0, 3), (10, 3), (2, 9), (5, 0), (8, 9)]), ("upright", [(0, 0), (6, 0), (6, 4), (3, 4), (3, -4), (0, -4)])]
    rows = [(k, [(float(x), float(y)) for x, y in r]) for k, r in rings]
    got = {r["key"]: r["crossings"] for r in overlay.ring_crossings(spark.createDataFrame(rows, "key string, ring array<struct<x: double, y: double>>"), 2.5).collect()}
    assert got == {"bow": 1, "star": 5, "upright": 1}
