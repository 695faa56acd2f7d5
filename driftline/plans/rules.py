"""Queries of rule lists: plans, decisions, cooldowns, memory, triggers, evaluation and the timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import guidance as G
from driftline.operators import spatial as S
from driftline.operators import temporal as T
from driftline.operators.relational import first_per_key
from driftline.plans.base import POINTS, epoch, mean_scale_sql, points, query, table
from driftline.plans.spatial import _RING_SQL, MAX_LAT, _axis_sql, _ring

# --- plans and decisions

_STOP = """stops AS (SELECT l_orderkey, row_number() OVER w AS stop, CASE WHEN l_partkey % 97 > 0 THEN l_partkey END AS identity, l_suppkey % 41 > 0 AS in_water, l_linenumber % 7 AS version, l_extendedprice / 100000.0 AS score, l_tax > 0.075 AS closed, l_quantity * 3 + l_linenumber * 60 AS arrives, l_quantity * 3 + l_linenumber * 60 + l_quantity AS departs, l_quantity - CASE WHEN l_discount > 0.095 THEN 1 ELSE 0 END AS stay
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice))"""


@query(f"""WITH {_STOP}, c AS (SELECT l_orderkey, stop, CASE WHEN identity IS NULL THEN 'MISSING_IDENTITY' WHEN NOT in_water THEN 'NOT_IN_WATER' WHEN version = 6 THEN 'SNAPSHOT_MISMATCH' WHEN score < 0 OR score > 1 THEN 'SCORE_RANGE' WHEN closed THEN 'REGULATION' WHEN arrives < 60 OR departs > 600 THEN 'OUTSIDE_WINDOW' WHEN departs <= arrives THEN 'OVERLAPPING_STAY' WHEN departs - arrives <> stay THEN 'DWELL_MISMATCH'
  WHEN arrives < lag(departs) OVER (PARTITION BY l_orderkey ORDER BY stop) THEN 'UNORDERED_TIMES' END AS code FROM stops)
SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'EMPTY' ELSE coalesce(arg_min(code, stop) FILTER (WHERE code IS NOT NULL), 'VALID') END AS verdict FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1""")
def alg_plan_validate(spark, d):
    """The first failing rule of the first failing stop of each plan; a plan without stops is empty."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    arrives = q * 3 + line * 60
    stops = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.row_number().over(w).alias("stop"), F.when(F.col("l_partkey") % 97 > 0, F.col("l_partkey")).alias("identity"), (F.col("l_suppkey") % 41 > 0).alias("in_water"), (line % 7 != 6).alias("same_snapshot"), (F.col("l_extendedprice") / 100000.0).alias("score"),
        (F.col("l_tax") > 0.075).alias("closed"), arrives.alias("arrives"), (arrives + q).alias("departs"), (q - F.when(F.col("l_discount") > 0.095, 1).otherwise(0)).alias("stay"),
    )
    verdicts = G.plan_verdicts(stops, F.lit(60), F.lit(600))
    plans = table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"))
    return plans.join(verdicts, "plan_id", "left").select(F.col("plan_id").alias("o_orderkey"), F.coalesce("verdict", F.lit("EMPTY")).alias("verdict"))


_CHECKED = f"""{POINTS}, c AS (SELECT *, lag(at) OVER w AS p_at, lag(kind) OVER w AS p_kind, lag(kind, 2) OVER w AS pp_kind, {mean_scale_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS metres, ({_RING_SQL}) % 2 = 1 AS closed FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)),
q AS (SELECT *, kind IN ('click', 'view') AS moves FROM c)"""
_CHECKS = {
    "SCHEMA_INVALID": "CASE WHEN kind IS NULL THEN 'FAIL' ELSE 'PASS' END",
    "ACTION_INCOMPATIBLE": "CASE WHEN kind = 'error' AND k % 2 = 0 THEN 'FAIL' ELSE 'PASS' END",
    "HORIZON_COMMIT_INVALID": "CASE WHEN k < 2 OR k > 97 THEN 'FAIL' ELSE 'PASS' END",
    "WAYPOINT_NOT_FOUND": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN k % 10 = 0 THEN 'FAIL' ELSE 'PASS' END",
    "WAYPOINT_NOT_NAVIGABLE": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN k % 10 = 0 THEN 'UNKNOWN' WHEN k % 10 = 9 THEN 'FAIL' ELSE 'PASS' END",
    "WAYPOINT_ID_INCONSISTENT": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN k % 10 = 0 THEN 'UNKNOWN' WHEN k % 14 = 3 THEN 'FAIL' ELSE 'PASS' END",
    "WAYPOINT_NOT_IN_SESSION": "CASE WHEN NOT moves OR k % 10 = 0 THEN 'NOT_APPLICABLE' WHEN k % 21 = 4 THEN 'FAIL' ELSE 'PASS' END",
    "WAYPOINT_NOT_ON_LAKE": "CASE WHEN NOT moves OR k % 10 = 0 THEN 'NOT_APPLICABLE' WHEN k % 26 = 5 THEN 'FAIL' ELSE 'PASS' END",
    "GPS_ACCURACY_UNACCEPTABLE": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN value > 150 THEN 'UNKNOWN' WHEN value > 60 THEN 'FAIL' ELSE 'PASS' END",
    "INSUFFICIENT_REMAINING_RANGE": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN metres IS NULL THEN 'UNKNOWN' WHEN metres > k * 200 THEN 'FAIL' ELSE 'PASS' END",
    "INSUFFICIENT_RETURN_RESERVE": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN metres IS NULL THEN 'UNKNOWN' WHEN metres + 3000 > k * 200 THEN 'FAIL' ELSE 'PASS' END",
    "INSUFFICIENT_REMAINING_TIME": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN metres IS NULL THEN 'UNKNOWN' WHEN metres / 200 > k + 5 THEN 'FAIL' ELSE 'PASS' END",
    "WEATHER_UNSAFE": "CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN value > 100 THEN 'FAIL' ELSE 'PASS' END",
    "NO_FISHING_ZONE": "CASE WHEN NOT moves THEN 'NOT_APPLICABLE' WHEN closed THEN 'FAIL' ELSE 'PASS' END",
    "OPPORTUNITY_IN_COOLDOWN": "CASE WHEN NOT moves OR p_at IS NULL THEN 'NOT_APPLICABLE' WHEN at - p_at < 3600 THEN 'FAIL' ELSE 'PASS' END",
    "MOVE_OSCILLATION": "CASE WHEN NOT moves OR pp_kind IS NULL THEN 'NOT_APPLICABLE' WHEN pp_kind = kind AND p_kind <> kind THEN 'FAIL' ELSE 'PASS' END",
}


@query(f"WITH {_CHECKED} " + " UNION ALL ".join(f"SELECT point_id, '{name}' AS check_name, {sql} AS verdict FROM q" for name, sql in _CHECKS.items()))
def alg_decision_checks(spark, d):
    """Sixteen checks of a decision, each PASS, FAIL, UNKNOWN or NOT_APPLICABLE."""
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    k = F.col("k")
    q = points(spark, d).select(
        "point_id", F.col("kind").alias("action"), F.col("kind").isin("click", "view").alias("moves"), (~((F.col("kind") == "error") & (k % 2 == 0))).alias("compatible"), k.alias("horizon"), (k % 10 > 0).alias("found"), F.when(k % 10 > 0, k % 10 != 9).alias("navigable"), F.when(k % 10 > 0, k % 14 != 3).alias("consistent"),
        (k % 21 != 4).alias("in_session"), (k % 26 != 5).alias("on_lake"), F.when(F.col("value") <= 150, F.col("value")).alias("accuracy"), geo.mean_scale_distance(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat").alias("metres"), (k * 200).alias("range_m"), (k + 5).alias("minutes_left"),
        F.col("value").alias("wind"), geo.in_ring("lon", "lat", _ring()).alias("closed"), (F.col("at") - F.lag("at").over(w)).alias("since"), F.lag("kind").over(w).alias("last_action"), F.lag("kind", 2).over(w).alias("action_before"),
    )
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), verdict.alias("verdict")) for name, verdict in G.decision_checks().items()]))
    return q.select("point_id", rows.alias("r")).select("point_id", "r.check_name", "r.verdict")


@query(f"WITH {POINTS}, v AS (SELECT session_id, point_id, at, lag(at + k * 10) OVER w AS departed, lag(k * 10) OVER w AS dwell, lag(CASE WHEN k % 3 = 2 THEN 3600 ELSE 2700 END) OVER w AS rest FROM points WINDOW w AS (PARTITION BY session_id, kind ORDER BY at, point_id)) SELECT session_id, point_id, CASE WHEN dwell >= 120 THEN departed + rest END AS cooldown_until, NOT coalesce(dwell >= 120 AND at < departed + rest, false) AS eligible FROM v")
def alg_revisit_cooldown(spark, d):
    """A place left after two minutes or more rests: 45 minutes for points and paths, 60 for zones."""
    kind = F.element_at(F.array(*map(F.lit, ("POINT", "PATH", "ZONE"))), (F.col("k") % 3 + 1).cast("int"))
    w = Window.partitionBy("session_id", "kind").orderBy("at", "point_id")
    v = points(spark, d).select("session_id", "point_id", "at", F.lag(F.col("at") + F.col("k") * 10).over(w).alias("departed"), F.lag(F.col("k") * 10).over(w).alias("dwell"), F.lag(kind).over(w).alias("visited"))
    until = G.cooldown_until("visited", "departed", "dwell")
    return v.select("session_id", "point_id", until.alias("cooldown_until"), (~F.coalesce(F.col("at") < until, F.lit(False))).alias("eligible"))


@query(f"""WITH {POINTS}, inferred AS (SELECT session_id, kind FROM points GROUP BY 1, 2 HAVING round(1 - exp(-count(*) / 3.0), 3) >= 0.6), stated AS (SELECT DISTINCT session_id, kind FROM points WHERE k >= 95),
ranked AS (SELECT session_id, point_id, kind, k, row_number() OVER (PARTITION BY session_id, kind ORDER BY at DESC, point_id DESC) AS rn FROM points WHERE kind IN ('purchase', 'signup', 'view') AND (kind <> 'purchase' OR value > 20)),
found AS (SELECT session_id, 1 AS part, 0 AS place, 'PREFERENCE' AS source, kind AS ref FROM inferred ANTI JOIN stated USING (session_id, kind) UNION ALL SELECT session_id, 2, 0, 'SUMMARY', CAST(k AS VARCHAR) FROM ranked WHERE kind = 'view' AND rn = 1
UNION ALL SELECT session_id, 3, rn, 'OUTCOME', CAST(k AS VARCHAR) FROM ranked WHERE kind = 'purchase' AND rn <= 8 UNION ALL SELECT session_id, 4, rn, 'NOTE', CAST(k AS VARCHAR) FROM ranked WHERE kind = 'signup' AND rn <= 8)
SELECT session_id, source, ref FROM found QUALIFY row_number() OVER (PARTITION BY session_id, ref ORDER BY part, place) = 1""")
def alg_memory_retrieval(spark, d):
    """Inferred preferences that no stated one covers, the latest summary, eight outcomes and eight notes; a reference comes once, where it comes first."""
    p = points(spark, d)
    prefs = p.groupBy("session_id", "kind").agg((1 - F.exp(-F.count("*") / F.lit(3.0))).alias("confidence"), F.bool_or(F.col("k") >= 95).alias("stated")).filter("round(confidence, 3) >= 0.6 AND NOT coalesce(stated, false)")
    w = Window.partitionBy("session_id", "kind").orderBy(F.desc("at"), F.desc("point_id"))
    ranked = p.filter("kind IN ('purchase', 'signup', 'view') AND (kind <> 'purchase' OR value > 20)").withColumn("place", F.row_number().over(w))
    take = lambda kind, part, source, n: ranked.filter((F.col("kind") == kind) & (F.col("place") <= n)).select("session_id", F.lit(part).alias("part"), "place", F.lit(source).alias("source"), F.col("k").cast("string").alias("ref"))
    found = prefs.select("session_id", F.lit(1).alias("part"), F.lit(0).alias("place"), F.lit("PREFERENCE").alias("source"), F.col("kind").alias("ref"))
    for part in (take("view", 2, "SUMMARY", 1), take("purchase", 3, "OUTCOME", 8), take("signup", 4, "NOTE", 8)):
        found = found.unionByName(part)
    return first_per_key(found, ["session_id", "ref"], F.asc("part"), F.asc("place")).select("session_id", "source", "ref")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 48 THEN 'SKIP' WHEN l_tax IS NULL THEN 'ERROR' WHEN l_discount = 0 AND l_linenumber % 2 = 0 THEN 'UNSCORABLE' WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 'FAIL:FORBIDDEN' WHEN l_returnflag NOT IN ('N', 'A') AND l_linenumber > 4 THEN 'FAIL:NOT_ALLOWED'
  WHEN l_suppkey % 5 = 0 AND l_returnflag <> 'N' THEN 'FAIL:NOT_EXACT' WHEN 0.4 * (l_tax < 0.05) :: INT + 0.3 * (l_discount < 0.06) :: INT + 0.3 * (l_quantity < 25) :: INT < 0.6 THEN 'FAIL:RUBRIC' ELSE 'PASS' END AS score FROM lineitem""")
def alg_eval_score(spark, d):
    """Simulations are skipped, other actions can't be scored; then forbidden, not allowed, not exact, and the rubric's weights."""
    l = table(spark, d, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    score = G.case_score(
        simulation=F.col("l_quantity") > 48, broken=F.col("l_tax").isNull(), other_action=(F.col("l_discount") == 0) & (line % 2 == 0), forbidden=(F.col("l_linestatus") == "F") & (line == 7), action=flag, allowed=F.when(line > 4, F.array(F.lit("N"), F.lit("A"))), exact=F.when(F.col("l_suppkey") % 5 == 0, F.lit("N")),
        rubric=[(F.col("l_tax") < 0.05, 0.4), (F.col("l_discount") < 0.06, 0.3), (F.col("l_quantity") < 25, 0.3)], least=0.6,
    )
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))


@query(f"WITH {POINTS}, l AS (SELECT *, sqrt(pow((lon - lag(lon) OVER w) * 111320.0 * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + pow((lat - lag(lat) OVER w) * 111320.0, 2)) AS m, ({_RING_SQL}) % 2 = 1 AS inside, lag(({_RING_SQL}) % 2 = 1) OVER w AS was_inside, row_number() OVER w AS entry FROM points WINDOW w AS (PARTITION BY session_id, at // 86400 ORDER BY at, point_id)) SELECT point_id, round(k / 100.0 * pow(0.9, entry - 1) + 0.12 * (1 - least(1.0, coalesce(m, 0) / 4000)) - CASE WHEN coalesce(inside <> was_inside, false) THEN 0.15 ELSE 0 END - 0.04 * least(1.0, coalesce(m, 0) / 200 / 30.0) - 0.002 * (k % 30), 6) AS gain FROM l")
def alg_route_increment(spark, d):
    """What one more visit adds: decayed utility, nearness, a crossing of the shore, minutes of travel and of waiting."""
    p = points(spark, d).withColumns({"day": F.floor(F.col("at") / 86_400), "inside": geo.in_ring("lon", "lat", _ring())})
    w = Window.partitionBy("session_id", "day").orderBy("at", "point_id")
    metres = F.coalesce(geo.axis_distance(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    l = p.select("point_id", "k", metres.alias("m"), F.coalesce(F.col("inside") != F.lag("inside").over(w), F.lit(False)).alias("crosses"), F.row_number().over(w).alias("entry"))
    gain = G.route_gain(F.col("k") / 100.0, "entry", "m", "crosses", F.col("m") / 200, 0.002 * (F.col("k") % 30))
    return l.select("point_id", F.round(gain, 6).alias("gain"))


# --- positions


@query(f"""WITH {POINTS}, last AS (SELECT session_id, arg_max(lon, at * 10000000 + point_id) AS x, arg_max(lat, at * 10000000 + point_id) AS y FROM points GROUP BY 1),
t AS (SELECT p.*, {mean_scale_sql('lon', 'lat', 'x', 'y')} AS m FROM points p JOIN last l ON l.session_id = p.session_id), s AS (SELECT *, sum(CASE WHEN k > 80 OR m > 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY at DESC, point_id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM t)
SELECT session_id, count(*) AS n, max(at) - min(at) AS seconds, round(max(m), 3) AS spread_m, count(*) >= 4 AND max(at) - min(at) >= 45 AND max(m) <= 5500 AS stationary FROM s WHERE broken = 0 GROUP BY 1""")
def win_trailing_slow(spark, d):
    """The run at a trace's end that is slow and near its last point; all after the last row that is neither, found without a window."""
    p = points(spark, d)
    order = F.struct("at", "point_id")
    last = p.groupBy("session_id").agg(F.max_by(F.struct("lon", "lat"), order).alias("last"))
    t = p.join(last, "session_id").withColumn("m", geo.mean_scale_distance("lon", "lat", F.col("last.lon"), F.col("last.lat")))
    broken = t.filter("k > 80 OR m > 6000").groupBy("session_id").agg(F.max(order).alias("broken"))
    tail = t.join(broken, "session_id", "left").filter(F.col("broken").isNull() | (order > F.col("broken")))
    n, span, spread = F.count("*"), F.max("at") - F.min("at"), F.max("m")
    return tail.groupBy("session_id").agg(n.alias("n"), span.alias("seconds"), F.round(spread, 3).alias("spread_m"), ((n >= 4) & (span >= 45) & (spread <= 5500)).alias("stationary"))


@query(f"WITH {POINTS}, m AS (SELECT a.session_id, a.point_id, min({_axis_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}) AS nearest FROM points a JOIN points b ON a.session_id = b.session_id AND a.kind = 'click' AND b.kind = 'click' AND a.point_id <> b.point_id AND {_axis_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} BETWEEN 0.001 AND 3000 GROUP BY 1, 2) SELECT session_id, count(*) AS n, round(avg(nearest), 3) AS mean_nearest FROM m GROUP BY 1")
def agg_mean_nearest(spark, d):
    """Mean distance to the nearest other place within reach, by cells; distances of nothing don't count."""
    p = points(spark, d).filter("kind = 'click'").select("session_id", "point_id", "lon", "lat")
    near = S.within_radius(p, p, 3000, MAX_LAT, ("session_id",)).filter("l_point_id <> r_point_id AND metres >= 0.001")
    nearest = near.groupBy(F.col("l_session_id").alias("session_id"), "l_point_id").agg(F.min("metres").alias("nearest"))
    return nearest.groupBy("session_id").agg(F.count("*").alias("n"), F.round(F.avg("nearest"), 3).alias("mean_nearest"))


@query(f"WITH {POINTS}, l AS (SELECT session_id, point_id, lag(lon) OVER w AS x, lag(lat) OVER w AS y, lon, lat FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)) SELECT session_id, point_id, round((degrees(atan2((lon - x) * cos(radians((y + lat) / 2)), lat - y)) + 360) % 360, 6) AS bearing, round({mean_scale_sql('x', 'y', 'lon', 'lat')}, 4) AS mean_scale_m, round({_axis_sql('x', 'y', 'lon', 'lat')}, 4) AS axis_m, round(abs((lon - x) * 111320.0 * cos(radians((y + lat) / 2)) * (lat - y) * 111320.0), 1) AS box_m2, round(60 / ((111320.0 + 111320.0 * cos(radians(lat))) / 2), 9) AS buffer_deg FROM l WHERE x IS NOT NULL AND (x <> lon OR y <> lat)")
def geo_equirect(spark, d):
    """Bearing, both distances, the area between two points' axes, and a buffer in degrees."""
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    rows = points(spark, d).withColumns({"x": F.lag("lon").over(w), "y": F.lag("lat").over(w)}).filter("x IS NOT NULL AND (x <> lon OR y <> lat)")
    box = geo.axis_distance("x", "y", "lon", F.col("y")) * 0 + F.abs((F.col("lon") - F.col("x")) * geo.METRES_PER_DEGREE * F.cos(F.radians((F.col("y") + F.col("lat")) / 2)) * (F.col("lat") - F.col("y")) * geo.METRES_PER_DEGREE)
    return rows.select("session_id", "point_id", F.round(geo.bearing("x", "y", "lon", "lat"), 6).alias("bearing"), F.round(geo.mean_scale_distance("x", "y", "lon", "lat"), 4).alias("mean_scale_m"), F.round(geo.axis_distance("x", "y", "lon", "lat"), 4).alias("axis_m"), F.round(box, 1).alias("box_m2"), F.round(geo.buffer_degrees(60, "lat"), 9).alias("buffer_deg"))


# --- timeline, triggers and summaries


_SOURCES = {"decision": ("events", "view", "k % 5 = 0"), "feedback": ("events", "view", "k % 5 = 1"), "catch": ("events", "purchase", "k % 10 < 8"), "lure": ("events", "click", "k % 2 = 0"), "progress": ("events", "click", "k % 2 = 1"), "signal": ("events", "error", "value > 5")}


@query(f"WITH {POINTS} " + " UNION ALL ".join(f"SELECT '{name}' AS source, {i} AS priority, point_id AS id, session_id, at FROM points WHERE kind = '{kind}' AND {keep}" for i, (name, (_, kind, keep)) in enumerate(_SOURCES.items())) + " UNION ALL SELECT 'order', 6, o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000000 FROM orders WHERE o_orderstatus <> 'P'")
def set_union_all_tagged(spark, d):
    """Seven sources in one shape, with their priority; what a source leaves out is left out before."""
    p = points(spark, d)
    parts = [p.filter((F.col("kind") == kind) & F.expr(keep)).select(F.lit(name).alias("source"), F.lit(i).alias("priority"), F.col("point_id").alias("id"), "session_id", "at") for i, (name, (_, kind, keep)) in enumerate(_SOURCES.items())]
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.lit("order").alias("source"), F.lit(6).alias("priority"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), epoch("o_orderdate").alias("at"))
    return reduce(lambda a, b: a.unionByName(b), [*parts, orders])


_RANKS = {"purchase": 0, "signup": 1, "click": 2, "view": 3}


@query(f"""WITH {POINTS}, g AS (SELECT session_id, at // 86400 AS day, kind, min(at * 10000000 + point_id) AS first, count(*) AS n, bool_or(value > 50) AS from_event, CASE kind {' '.join(f"WHEN '{k}' THEN {r}" for k, r in _RANKS.items())} END AS rank FROM points WHERE kind <> 'error' GROUP BY 1, 2, 3)
SELECT session_id, day, arg_min(kind, rank) AS trigger, string_agg(kind, ',' ORDER BY first) AS reasons, CAST(sum(n) AS BIGINT) AS n, CASE WHEN bool_or(from_event) THEN 'EVENT' ELSE 'HEARTBEAT' END AS source FROM g GROUP BY 1, 2""")
def stm_coalesce(spark, d):
    """Open triggers of a session and day as one: the best rank leads, reasons join in order of coming, requests of the user are left out, and an event's source sticks."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in _RANKS.items() for x in pair]), F.col("kind"))
    g = points(spark, d).filter("kind <> 'error'").groupBy("session_id", F.floor(F.col("at") / 86_400).alias("day"), "kind").agg(F.min(F.struct("at", "point_id")).alias("first"), F.count("*").alias("n"), F.bool_or(F.col("value") > 50).alias("from_event")).withColumn("rank", rank)
    reasons = F.transform(F.sort_array(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"])
    return g.groupBy("session_id", "day").agg(F.min_by("kind", "rank").alias("trigger"), F.array_join(reasons, ",").alias("reasons"), F.sum("n").alias("n"), F.when(F.bool_or("from_event"), "EVENT").otherwise("HEARTBEAT").alias("source"))


@query(f"WITH {POINTS}, s AS (SELECT *, kind IN ('click', 'error') OR k % 10 = 0 AS resets FROM points), g AS (SELECT session_id, point_id, at, k, lead(at) OVER (PARTITION BY session_id ORDER BY at, point_id) AS next_at FROM s WHERE resets) SELECT session_id, point_id, at + 86400 AS fires_at FROM g WHERE next_at - at >= 86400 AND k % 4 > 0")
def stm_no_bite(spark, d):
    """One trigger for each stretch of a day without a signal or a change of state, if the state then is fishing."""
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    resets = F.col("kind").isin("click", "error") | (F.col("k") % 10 == 0)
    g = points(spark, d).filter(resets).withColumn("next_at", F.lead("at").over(w))
    return g.filter((F.col("next_at") - F.col("at") >= 86_400) & (F.col("k") % 4 > 0)).select("session_id", "point_id", (F.col("at") + 86_400).alias("fires_at"))


@query("SELECT o_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus = 'P'), 0) AS version FROM orders GROUP BY 1")
def agg_max_default(spark, d):
    """The greatest version of a plan, zero where it has none."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))), F.lit(0)).alias("version"))


@query(f"WITH {POINTS}, s AS (SELECT session_id, count(*) FILTER (WHERE kind = 'purchase') AS landed, sum(k * 60) FILTER (WHERE kind = 'view') AS effort, arg_max(k % 6, at * 10000000 + point_id) AS species FROM points GROUP BY 1), c AS (SELECT session_id % 5 AS lake, * FROM s WHERE session_id % 4 > 0) SELECT lake, count(*) AS sessions, CAST(sum(landed) AS BIGINT) AS landed, round(sum(effort) / 3600.0, 3) AS hours, round(sum(landed) / (sum(effort) / 3600.0), 6) AS cpue, arg_max(species, session_id) AS species FROM c GROUP BY 1")
def agg_lake_summary(spark, d):
    """Completed sessions of each lake; the species is that of the last session by id, where the order was left open."""
    kind = F.col("kind")
    s = points(spark, d).groupBy("session_id").agg(F.count_if(kind == "purchase").alias("landed"), F.sum(F.when(kind == "view", F.col("k") * 60)).alias("effort"), F.max_by(F.col("k") % 6, F.struct("at", "point_id")).alias("species"))
    hours = F.sum("effort") / 3600.0
    return s.filter("session_id % 4 > 0").groupBy((F.col("session_id") % 5).alias("lake")).agg(F.count("*").alias("sessions"), F.sum("landed").alias("landed"), F.round(hours, 3).alias("hours"), F.round(F.sum("landed") / hours, 6).alias("cpue"), F.max_by("species", "session_id").alias("species"))


@query(f"WITH {POINTS}, m AS (SELECT session_id, point_id, at, kind, lead(at) OVER w AS until, k % 4 AS waypoint, k % 7 AS zone, value / 200 AS confidence FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)), d AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND CASE WHEN waypoint > 0 THEN waypoint END IS NOT DISTINCT FROM lag(CASE WHEN waypoint > 0 THEN waypoint END) OVER w THEN 0 ELSE 1 END AS fresh FROM m WHERE until > at WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS island FROM d) SELECT session_id, kind, CASE WHEN waypoint > 0 THEN waypoint END AS waypoint, min(at) AS start, max(until) AS \"end\", first(zone ORDER BY at, point_id) AS zone, round(max(confidence), 6) AS confidence FROM n GROUP BY session_id, island, kind, CASE WHEN waypoint > 0 THEN waypoint END")
def win_gaps_islands(spark, d):
    """Neighbours of equal kind and waypoint become one; its zone is the first one's, its confidence the greatest."""
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    m = points(spark, d).select("session_id", "point_id", "at", "kind", F.lead("at").over(w).alias("until"), F.when(F.col("k") % 4 > 0, F.col("k") % 4).alias("waypoint"), (F.col("k") % 7).alias("zone"), (F.col("value") / 200).alias("confidence")).filter("until > at")
    breaks = ~(F.lag("kind").over(w).eqNullSafe(F.col("kind")) & F.lag("waypoint").over(w).eqNullSafe(F.col("waypoint")) & F.lag("until").over(w).eqNullSafe(F.col("at")))
    # Rows without length are gone, so touching is a matter of the drafts themselves.
    found = T.islands(m, ["session_id"], ["at", "point_id"], breaks)
    return found.groupBy("session_id", "island", "kind", "waypoint").agg(F.min("at").alias("start"), F.max("until").alias("end"), F.min_by("zone", F.struct("at", "point_id")).alias("zone"), F.round(F.max("confidence"), 6).alias("confidence")).drop("island")
