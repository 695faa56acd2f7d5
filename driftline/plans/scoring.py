"""Queries of scores, limits and choices of planning and guidance, and of scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import geo, planning, scores
from driftline.operators.relational import first_per_key
from driftline.plans.base import POINTS, mean_scale_sql, points, query, table


def _pick(names: tuple[str, ...], index):
    """The name at ``index`` modulo their number."""
    return F.element_at(F.array(*map(F.lit, names)), (index % len(names) + 1).cast("int"))


def _pick_sql(names: tuple[str, ...], index: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][{index} % {len(names)} + 1]"


# --- evidence and confidence


@query("""WITH q AS (SELECT p_partkey, least(1.0, p_retailprice / 2117.0) AS quality, (p_size - 10) / 20.0 AS prominence, p_size % 2 = 0 AS bathymetry, p_size % 3 = 0 AS consistent,
  CASE WHEN p_size % 5 > 0 THEN p_size * 6.0 END AS metres, p_size % 4 AS types FROM part)
SELECT p_partkey, round(least(0.99, greatest(0.05, 0.20 * quality + 0.25 * CASE WHEN prominence <= 0 THEN 0.2 ELSE least(1.0, prominence) END + 0.15 * CASE WHEN bathymetry THEN 1.0 ELSE 0.35 END
  + 0.15 * CASE WHEN consistent THEN 1.0 ELSE 0.4 END + 0.10 * CASE WHEN metres IS NULL THEN 0.7 WHEN metres <= 20 THEN 1.0 WHEN metres >= 250 THEN 0.25 ELSE 1.0 - (metres - 20) / 230.0 * 0.75 END + 0.15 * least(1.0, types / 3.0))), 4) AS confidence FROM q""")
def agg_feature_confidence(spark, d):
    size = F.col("p_size")
    metres = F.when(size % 5 > 0, size * 6.0)
    return table(spark, d, "part").select("p_partkey", planning.feature_confidence(F.least(F.lit(1.0), F.col("p_retailprice") / 2117.0), (size - 10) / F.lit(20.0), size % 2 == 0, size % 3 == 0, metres, size % 4).alias("confidence"))


_CODES = ("STRUCTURE_NONE_AFTER_ANALYSIS", "STRUCTURE_DATA_LOW_CONFIDENCE", "TARGET_SPECIES_UNCONFIRMED", "WEATHER_STALE", "DEPTH_UNKNOWN")
_WEATHER = ("FORECAST_AVAILABLE", "OUT_OF_FORECAST_RANGE", "UNAVAILABLE", "FAILED")
_READY = ("READY", "PARTIAL", "FAILED", "NOT_READY")


@query(f"""WITH q AS (SELECT session_id, {_pick_sql(_WEATHER, 'session_id')} AS weather, {_pick_sql(_READY, 'session_id // 4')} AS ready, avg(value) / 200 AS mean, list_distinct(list({_pick_sql(_CODES, 'k')}) FILTER (WHERE k % 9 < 4)) AS codes FROM (SELECT user_id AS session_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2, 3),
t AS (SELECT session_id, 0.62 + CASE weather WHEN 'FORECAST_AVAILABLE' THEN 0.12 WHEN 'OUT_OF_FORECAST_RANGE' THEN -0.08 ELSE -0.1 END + CASE ready WHEN 'READY' THEN 0.12 WHEN 'PARTIAL' THEN 0.04 ELSE -0.16 END
  + CASE WHEN coalesce(list_contains(codes, 'STRUCTURE_NONE_AFTER_ANALYSIS'), false) THEN -0.1 ELSE 0 END + CASE WHEN coalesce(list_contains(codes, 'STRUCTURE_DATA_LOW_CONFIDENCE'), false) THEN -0.08 ELSE 0 END + coalesce((mean - 0.5) * 0.1, 0)
  + CASE WHEN coalesce(list_contains(codes, 'TARGET_SPECIES_UNCONFIRMED'), false) THEN -0.08 ELSE 0.06 END - least(0.2, 0.03 * coalesce(len(codes), 0)) AS total FROM q)
SELECT session_id, round(CASE WHEN total < 0.05 THEN 0.05 WHEN total > 0.95 THEN 0.95 ELSE total END, 4) AS confidence FROM t""")
def alg_system_confidence(spark, d):
    p = points(spark, d).withColumn("code", F.when(F.col("k") % 9 < 4, _pick(_CODES, F.col("k"))))
    q = p.groupBy("session_id").agg((F.avg("value") / 200).alias("mean"), F.collect_set("code").alias("codes"))
    s = F.col("session_id")
    return q.select("session_id", F.round(planning.system_confidence(_pick(_WEATHER, s), _pick(_READY, F.floor(s / 4)), "mean", "codes"), 4).alias("confidence"))


@query("SELECT p_partkey, round(least(CASE WHEN p_size % 3 > 0 AND p_retailprice > 0 THEN p_retailprice * (1 - least(0.9, greatest(0, p_size / 40.0))) END, CASE WHEN p_size % 4 > 0 THEN p_size * 20.0 END), 6) AS km FROM part")
def alg_feasible_boat_range(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(planning.usable_range("p_retailprice", size / F.lit(40.0), size % 3 > 0, F.when(size % 4 > 0, size * 20.0)), 6).alias("km"))


# --- spots


_TECHNIQUES = ("JIG", "JERKBAIT", "TROLLING", "OTHER", "TOPWATER")
_GEAR = ("BAIT", "LURE", "ROD", "ELECTRONICS")


@query(f"""WITH q AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN [] :: VARCHAR[] ELSE [{_pick_sql(_TECHNIQUES, 'p_size')}, {_pick_sql(_TECHNIQUES, 'p_size // 5')}] END AS asked, CASE WHEN p_size % 11 = 0 THEN NULL ELSE list_filter([{_pick_sql(_GEAR, 'p_size')}, {_pick_sql(_GEAR, 'p_size // 4')}], lambda g: g <> 'LURE') END AS gear FROM part),
s AS (SELECT *, len(list_filter(asked, lambda t: (t IN ('NED_RIG', 'DROP_SHOT', 'TEXAS_RIG', 'TUBE', 'JIG', 'LIVE_BAIT') AND list_contains(gear, 'BAIT')) OR (t = 'TROLLING' AND (list_contains(gear, 'ROD') OR list_contains(gear, 'ELECTRONICS'))) OR (t = 'OTHER' AND list_contains(gear, 'ROD')))) > 0 AS served FROM q)
SELECT p_partkey, CAST(CASE WHEN gear IS NULL OR len(gear) = 0 THEN 0.5 WHEN len(asked) = 0 THEN CASE WHEN list_contains(gear, 'ROD') THEN 0.75 ELSE 0.5 END WHEN served THEN 1.0 WHEN list_contains(gear, 'ROD') THEN 0.75 ELSE 0.4 END AS DOUBLE) AS fit FROM s""")
def alg_gear_compat(spark, d):
    size = F.col("p_size")
    asked = F.when(size % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(_pick(_TECHNIQUES, size), _pick(_TECHNIQUES, F.floor(size / 5))))
    gear = F.when(size % 11 > 0, F.array(_pick(_GEAR, size), _pick(_GEAR, F.floor(size / 4))))
    return table(spark, d, "part").select("p_partkey", planning.gear_compatibility(asked, gear).alias("fit"))


@query(f"""WITH {POINTS}, w AS (SELECT session_id, kind AS type, arg_min(k, at * 10000000 + point_id) AS weight, 1 AS side FROM points WHERE session_id % 3 > 0 AND kind <> 'view' AND k > 30 GROUP BY 1, 2),
g AS (SELECT session_id, kind AS type, arg_min(k, at * 10000000 + point_id) AS weight, 2 AS side FROM points GROUP BY 1, 2)
SELECT session_id, type, weight / 100.0 AS weight, CASE side WHEN 1 THEN 'WINDOW' ELSE 'PROFILE' END AS source FROM (SELECT * FROM w UNION ALL SELECT * FROM g) QUALIFY row_number() OVER (PARTITION BY session_id, type ORDER BY side) = 1""")
def alg_strategy_weights(spark, d):
    """Preferences of a window by type; types that it does not name have those of the profile."""
    p = points(spark, d)
    first = lambda rows, side: rows.groupBy("session_id", F.col("kind").alias("type")).agg(F.min_by("k", F.struct("at", "point_id")).alias("weight"), F.lit(side).alias("side"))
    both = first(p.filter("session_id % 3 > 0 AND kind <> 'view' AND k > 30"), 1).unionByName(first(p, 2))
    merged = both.groupBy("session_id", "type").agg(F.min_by("weight", "side").alias("weight"), F.min("side").alias("side"))
    return merged.select("session_id", "type", (F.col("weight") / 100.0).alias("weight"), F.when(F.col("side") == 1, "WINDOW").otherwise("PROFILE").alias("source"))


_LIGHT = ("SUN_EXPOSED", "SHADE_PREFERRED", "TRANSITION_PREFERRED", "NEUTRAL")
_SURE = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
_SUNNY = f"""sunny AS (SELECT point_id, {_pick_sql(_LIGHT, 'k')} AS light, {_pick_sql(_SURE, 'k // 4')} AS sure, k * 3.6 AS azimuth, k - 20.0 AS elevation, CASE WHEN k % 7 > 0 THEN value * 2 END AS facing, least(1.0, value / 97) AS strength FROM points),
exposed AS (SELECT *, CASE WHEN elevation <= 0 OR strength <= 0 THEN 0 WHEN facing IS NULL OR sure = 'UNKNOWN' THEN 0.5 * strength
  ELSE least(1.0, greatest(0.0, (1 - abs(fmod(fmod(azimuth - facing + 540, 360) + 360, 360) - 180) / 180) * strength * CASE sure WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 ELSE 0.4 END)) END AS exposure FROM sunny),
lit AS (SELECT *, CASE WHEN strength > 0 THEN CASE light WHEN 'SUN_EXPOSED' THEN (exposure - 0.5) * 2 WHEN 'SHADE_PREFERRED' THEN (0.5 - exposure) * 2 WHEN 'TRANSITION_PREFERRED' THEN 1 - abs(exposure - 0.5) * 2 ELSE 0 END * 0.12 * strength ELSE 0 END AS effect FROM exposed)"""


def _lit(spark, d):
    k, v = F.col("k"), F.col("value")
    rows = points(spark, d).select("point_id", "k", "value", "kind", _pick(_LIGHT, k).alias("light"), _pick(_SURE, F.floor(k / 4)).alias("sure"), (k * 3.6).alias("azimuth"), (k - 20.0).alias("elevation"), F.when(k % 7 > 0, v * 2).alias("facing"), F.least(F.lit(1.0), v / 97).alias("strength"))
    rows = rows.withColumn("exposure", planning.solar_exposure("azimuth", "elevation", "facing", "sure", "strength"))
    return rows.withColumn("effect", planning.solar_effect("light", "exposure", "strength", 0.12))


@query(f"WITH {POINTS}, {_SUNNY} SELECT point_id, round(exposure, 6) AS exposure, round(effect, 6) AS effect FROM lit")
def alg_solar_effect(spark, d):
    return _lit(spark, d).select("point_id", F.round("exposure", 6).alias("exposure"), F.round("effect", 6).alias("effect"))


@query(f"""WITH {POINTS}, {_SUNNY}, u AS (SELECT p.point_id, p.k / 100.0 + (p.value / 100 - 0.5) * 0.35 + (p.k % 10 / 10.0 - 0.5) * 0.25 + effect + CASE WHEN abs(fmod(p.k * 3.6 - 90 + 540, 360) - 180) <= 45 THEN -0.35 WHEN abs(fmod(p.k * 3.6 - 90 + 540, 360) - 180) >= 135 THEN 0.6 ELSE 0.15 END * 0.1
  + (1 - least(1.0, abs(p.value - 18) / 20) - 0.5) * 2 * 0.03 - CASE WHEN p.kind = 'click' THEN least(1.0, greatest(0.0, (p.value - 20) / 60.0)) ELSE 0 END - 0.02 * (p.k % 3) AS total FROM points p JOIN lit USING (point_id))
SELECT point_id, round(least(1.5, greatest(0.0, total)), 6) AS utility FROM u""")
def alg_time_utility(spark, d):
    """Intrinsic score, changed terms, sun, wind and temperature, less boat and wait."""
    k, v = F.col("k"), F.col("value")
    changes = [(v / 100 - 0.5, 0.35), (k % 10 / 10.0 - 0.5, 0.25)]
    effects = [F.col("effect"), scores.wind_effect(k * 3.6, F.lit(90.0), F.lit(0.1)), scores.temperature_effect("value", F.lit(0.03))]
    costs = [F.when(F.col("kind") == "click", scores.linear_penalty("value", 20.0, 80.0)).otherwise(0.0), 0.02 * (k % 3)]
    return _lit(spark, d).select("point_id", F.round(planning.time_utility(k / 100.0, changes, effects, costs), 6).alias("utility"))


_STOPS = ("ZONE", "PATH", "POINT", "ISLAND_EDGE", "FLAT", "BASIN", "HUMP")


@query(f"""WITH q AS (SELECT p_partkey, {_pick_sql(_STOPS, 'p_size')} AS kind, CASE WHEN p_size % 5 > 0 THEN p_size / 50.0 END AS confidence, CAST(p_retailprice / 8 AS INT) - 30 AS remaining FROM part),
r AS (SELECT *, CASE WHEN kind = 'ZONE' THEN [45, 90, 135, 180] WHEN kind = 'PATH' THEN [30, 45, 60, 90] WHEN kind IN ('POINT', 'ISLAND_EDGE') THEN [15, 20, 30, 45] ELSE [20, 30, 45, 60, 75, 90] END AS offered,
  CASE kind WHEN 'ZONE' THEN 45 WHEN 'PATH' THEN 30 WHEN 'POINT' THEN 15 WHEN 'ISLAND_EDGE' THEN 15 WHEN 'FLAT' THEN 45 WHEN 'BASIN' THEN 30 ELSE 20 END AS low,
  least(least(CASE kind WHEN 'ZONE' THEN 180 WHEN 'POINT' THEN 45 WHEN 'ISLAND_EDGE' THEN 45 WHEN 'BASIN' THEN 60 ELSE 90 END, CASE WHEN coalesce(confidence, 0.5) < 0.45 AND kind <> 'ZONE' THEN 45 ELSE 1000 END), greatest(0, remaining)) AS high FROM q)
SELECT p_partkey, coalesce(nullif(array_to_string(list_filter(offered, lambda m: m >= low AND m <= high), ','), ''), CASE WHEN high >= 8 THEN CAST(least(high, greatest(low, 8)) AS VARCHAR) ELSE '' END) AS minutes FROM r""")
def alg_dwell_policy(spark, d):
    size = F.col("p_size")
    remaining = F.bround(F.col("p_retailprice") / 8).cast("int") - 30
    options = planning.dwell_options(_pick(_STOPS, size), F.when(size % 5 > 0, size / F.lit(50.0)), remaining)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(options, lambda m: m.cast("string")), ",").alias("minutes"))


@query(f"WITH {POINTS}, l AS (SELECT session_id, point_id, kind, {mean_scale_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS metres FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)) SELECT point_id, round(metres * CASE WHEN kind = 'error' THEN 2.2 ELSE 1.35 END / (12 * 1000 / 60.0), 6) AS minutes FROM l")
def alg_travel_time(spark, d):
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    metres = geo.mean_scale_distance(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat")
    return points(spark, d).select("point_id", F.round(planning.travel_minutes(metres, F.col("kind") == "error", F.lit(12.0)), 6).alias("minutes"))


@query("""WITH q AS (SELECT *, p_size % 13 > 0 AS placed, p_size % 5 > 0 AS water, p_size % 7 = 0 AS island, CASE WHEN p_size % 2 = 0 THEN 'SHORE' ELSE 'BOAT' END AS mode, CASE WHEN p_size % 3 > 0 THEN p_size * 3.0 END AS shore_m, p_size % 4 = 0 AS verified FROM part),
r AS (SELECT *, CASE WHEN NOT placed THEN 'INVALID_GEOMETRY' WHEN NOT water THEN 'OUTSIDE_LAKE' WHEN island THEN 'ON_ISLAND' WHEN mode = 'SHORE' AND shore_m > 80 THEN 'SHORE_INACCESSIBLE' END AS reason FROM q)
SELECT p_partkey, reason, CASE WHEN reason IS NULL AND mode = 'SHORE' AND NOT verified THEN 'SHORE_ACCESS_UNVERIFIED' END AS warning FROM r""")
def flt_accessibility(spark, d):
    size = F.col("p_size")
    found = planning.accessibility(size % 13 > 0, size % 5 > 0, size % 7 == 0, F.when(size % 2 == 0, "SHORE").otherwise("BOAT"), F.when(size % 3 > 0, size * 3.0), size % 4 == 0)
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in found.items()])


# --- guidance


_ACTIONS = ("MOVE", "STAY", "CHANGE_LURE", "CHANGE_DEPTH", "CHANGE_RETRIEVE", "RETURN")


@query(f"WITH {POINTS}, q AS (SELECT point_id, k, {_pick_sql(_ACTIONS, 'k')} AS action FROM points) SELECT point_id, action, CASE WHEN action IN ('MOVE', 'STAY') THEN 'LOCATION' WHEN action = 'RETURN' THEN NULL ELSE substr(action, 8) END AS dimension, CAST(CASE action WHEN 'CHANGE_LURE' THEN 15 WHEN 'CHANGE_DEPTH' THEN 15 WHEN 'CHANGE_RETRIEVE' THEN 10 WHEN 'MOVE' THEN 30 WHEN 'STAY' THEN least(greatest(k - 5, 1), 30) ELSE 0 END AS BIGINT) AS minutes FROM q")
def alg_window_policy(spark, d):
    action = _pick(_ACTIONS, F.col("k"))
    return points(spark, d).select("point_id", action.alias("action"), planning.action_dimension(action).alias("dimension"), planning.action_window_minutes(action, F.col("k") - 5).cast("long").alias("minutes"))


_SEEN = ("WAYPOINT_ENTERED", "WAYPOINT_LEFT", "LURE_CHANGED", "DEPTH_CHANGED", "RETRIEVE_CHANGED", "ADVICE_REJECTED", "ADVICE_CREATED", "ADVICE_ACCEPTED", "ADVICE_ACKNOWLEDGED")


@query(f"""WITH {POINTS}, q AS (SELECT point_id, k, value, {_pick_sql(_SEEN, 'k')} AS event, unnest([{_pick_sql(_ACTIONS, 'k // 9')}, {_pick_sql(_ACTIONS, '(k // 9 + 3)')}]) AS action FROM points),
r AS (SELECT *, CASE WHEN event = 'ADVICE_REJECTED' THEN false WHEN event = 'WAYPOINT_ENTERED' AND action = 'MOVE' THEN k % 4 = 1 WHEN event IN ('WAYPOINT_ENTERED', 'WAYPOINT_LEFT') AND action = 'STAY' THEN true
  WHEN event IN ('LURE_CHANGED', 'DEPTH_CHANGED', 'RETRIEVE_CHANGED') AND action = 'CHANGE_LURE' THEN k % 3 = 1 WHEN event IN ('LURE_CHANGED', 'DEPTH_CHANGED', 'RETRIEVE_CHANGED') AND action = 'CHANGE_RETRIEVE' THEN coalesce(CASE WHEN k % 5 > 0 THEN k % 5 END = 2, false)
  WHEN event IN ('LURE_CHANGED', 'DEPTH_CHANGED', 'RETRIEVE_CHANGED') AND action = 'CHANGE_DEPTH' THEN coalesce(value BETWEEN 10 AND 60, false) WHEN event IN ('ADVICE_CREATED', 'ADVICE_ACCEPTED') AND action = 'STAY' AND k % 2 = 0 THEN true END AS followed FROM q)
SELECT point_id, event, action, followed FROM r WHERE followed IS NOT NULL""")
def alg_infer_action(spark, d):
    """Observed actions: a row for each advised action that the event says something of."""
    k = F.col("k")
    rows = points(spark, d).select("point_id", "k", "value", _pick(_SEEN, k).alias("event"), F.explode(F.array(_pick(_ACTIONS, F.floor(k / 9)), _pick(_ACTIONS, F.floor(k / 9) + 3))).alias("action"))
    followed = planning.inferred_follow("event", "action", k % 4, F.lit(1), k % 3, F.lit(1), F.when(k % 5 > 0, k % 5), F.lit(2), "value", F.lit(10), F.lit(60), k % 2 == 0)
    return rows.withColumn("followed", followed).filter("followed IS NOT NULL").select("point_id", "event", "action", "followed")


_STATUS = ("FISHING", "ARRIVED", "NAVIGATING", "COMPLETED", "UPCOMING")
_STATE_SQL = f"""rows AS (SELECT point_id, k, value, CASE WHEN k % 11 = 0 THEN 'FISHING' WHEN k % 11 = 1 THEN 'UNKNOWN' END AS override, k % 7 = 0 AS paused, k % 5 = 0 AS ad_hoc, CASE WHEN k % 3 = 0 THEN {_pick_sql(_STATUS, 'k')} END AS target, {_pick_sql(_STATUS, 'k // 3')} AS current FROM points),
states AS (SELECT *, CASE WHEN override IS NOT NULL AND override <> 'UNKNOWN' THEN 'OVERRIDE' WHEN paused THEN 'SESSION_PAUSE' WHEN ad_hoc THEN 'USER_AD_HOC' WHEN target IN ('FISHING', 'ARRIVED') OR current IN ('FISHING', 'NAVIGATING') THEN 'PROGRESS' ELSE 'UNKNOWN' END AS source,
  CASE WHEN override IS NOT NULL AND override <> 'UNKNOWN' THEN override WHEN paused THEN 'PAUSED' WHEN ad_hoc OR target IN ('FISHING', 'ARRIVED') OR current = 'FISHING' THEN 'FISHING' WHEN current = 'NAVIGATING' THEN 'TRANSIT' ELSE 'UNKNOWN' END AS state FROM rows)"""


def _states(spark, d):
    k = F.col("k")
    target = F.when(k % 3 == 0, _pick(_STATUS, k))
    found = planning.activity_state(F.when(k % 11 == 0, "FISHING").when(k % 11 == 1, "UNKNOWN"), k % 7 == 0, k % 5 == 0, target, _pick(_STATUS, F.floor(k / 3)))
    return points(spark, d).withColumns(found)


@query(f"WITH {POINTS}, {_STATE_SQL} SELECT point_id, state, source FROM states")
def stm_activity_state(spark, d):
    return _states(spark, d).select("point_id", "state", "source")


@query(f"WITH {POINTS}, {_STATE_SQL} SELECT point_id, state = 'FISHING' AND CAST(floor(value / 3) AS BIGINT) >= 20 AS due FROM states")
def alg_no_bite_rule(spark, d):
    return _states(spark, d).select("point_id", planning.no_bite_due("state", F.floor(F.col("value") / 3)).alias("due"))


@query(f"WITH {POINTS}, n AS (SELECT kind, at // 86400 AS day, count(DISTINCT session_id) % 4 AS anglers FROM points WHERE value > 50 GROUP BY 1, 2) SELECT kind, day, anglers, CASE WHEN anglers <= 0 THEN 'LOW' WHEN anglers <= 2 THEN 'MODERATE' ELSE 'HIGH' END AS pressure FROM n")
def alg_pressure(spark, d):
    n = points(spark, d).filter("value > 50").groupBy("kind", F.floor(F.col("at") / 86_400).alias("day")).agg((F.count_distinct("session_id") % 4).alias("anglers"))
    return n.withColumn("pressure", planning.pressure("anglers"))


# --- sorts, choices and counts


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 500")
def srt_multi_key(spark, d):
    """Two keys falling; the limit shows that the order holds."""
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderdate").limit(500)


_GRAIN = "SELECT CASE WHEN l_partkey % 4 > 0 THEN l_returnflag END AS flag, CASE WHEN l_suppkey % 3 > 0 THEN l_linestatus END AS status, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"


@query(f"WITH g AS ({_GRAIN}) SELECT flag, status, line, n, row_number() OVER (ORDER BY flag NULLS FIRST, status NULLS FIRST, line) AS place FROM g")
def srt_nulls_first(spark, d):
    """Grains in order, unknown dimensions first; a bounded number of grains is numbered."""
    g = table(spark, d, "lineitem").groupBy(F.when(F.col("l_partkey") % 4 > 0, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linestatus")).alias("status"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("flag"), F.asc_nulls_first("status"), "line")).cast("long"))


@query(f"WITH {POINTS} SELECT session_id, arg_max(point_id, at * 10000000 + point_id) AS point_id, max(at) AS at FROM points WHERE value < 100 GROUP BY 1")
def win_first_desc(spark, d):
    """The first row of a falling order, as a maximum."""
    return points(spark, d).filter("value < 100").groupBy("session_id").agg(F.max_by("point_id", F.struct("at", "point_id")).alias("point_id"), F.max("at").alias("at"))


@query(f"WITH {POINTS}, t AS (SELECT session_id, max(at) FILTER (WHERE kind = 'purchase') AS departed, max(at) FILTER (WHERE kind = 'click' AND k > 80) AS completed, max(at) FILTER (WHERE kind = 'error') AS skipped, max(at) AS ended FROM points WHERE k % 6 = 0 GROUP BY 1) SELECT session_id, coalesce(departed, completed, skipped, ended) AS left_at FROM t")
def prj_first_non_null(spark, d):
    last = lambda condition: F.max(F.when(condition, F.col("at")))
    kind = F.col("kind")
    t = points(spark, d).filter("k % 6 = 0").groupBy("session_id").agg(last(kind == "purchase").alias("departed"), last((kind == "click") & (F.col("k") > 80)).alias("completed"), last(kind == "error").alias("skipped"), F.max("at").alias("ended"))
    return t.select("session_id", F.coalesce("departed", "completed", "skipped", "ended").alias("left_at"))


@query("SELECT count(*) AS occupied FROM orders WHERE o_orderstatus IN ('O', 'P')")
def agg_slots(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P")).agg(F.count("*").alias("occupied"))


@query("SELECT l_returnflag || '|' || l_linestatus AS key, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def agg_map_merge(spark, d):
    return table(spark, d, "lineitem").groupBy(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("key")).agg(F.sum("l_linenumber").alias("total"))


@query("WITH m AS (SELECT l_linenumber AS type, l_orderkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_linestatus = 'F') AS b FROM lineitem GROUP BY 1, 2) SELECT type, count(*) FILTER (WHERE a AND b) AS matched, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only FROM m GROUP BY 1")
def agg_agreement(spark, d):
    """Both, left alone and right alone, by type; one aggregation serves all three."""
    m = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("type"), "l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_linestatus") == "F").alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.groupBy("type").agg(F.count_if(a & b).alias("matched"), F.count_if(a & ~b).alias("left_only"), F.count_if(b & ~a).alias("right_only"))


@query("SELECT l_linenumber AS version, count(*) AS n, count(*) FILTER (WHERE l_tax > 0.05) AS validated, count(*) FILTER (WHERE l_tax > 0.05 AND l_discount > 0.05) AS failed, count(*) FILTER (WHERE l_tax <= 0.05) AS skipped, round(count(*) FILTER (WHERE l_tax > 0.05 AND l_discount <= 0.05) / nullif(count(*) FILTER (WHERE l_tax > 0.05), 0), 6) AS valid_rate FROM lineitem GROUP BY 1")
def agg_validation_counters(spark, d):
    checked, failed = F.col("l_tax") > 0.05, F.col("l_discount") > 0.05
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("version")).agg(
        F.count("*").alias("n"), F.count_if(checked).alias("validated"), F.count_if(checked & failed).alias("failed"), F.count_if(~checked).alias("skipped"), F.round(scores.rate(F.count_if(checked & ~failed), F.count_if(checked)), 6).alias("valid_rate")
    )


@query(f"WITH {POINTS}, plans AS (SELECT session_id, at // 86400 AS day, count(*) AS stops, round(sum(value), 6) AS score FROM points GROUP BY 1, 2) SELECT session_id, day, stops, score FROM plans QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY stops >= 3 DESC, score DESC, day) = 1")
def alg_pick_best(spark, d):
    """The best plan of a session; one with enough stops goes before any with fewer."""
    plans = points(spark, d).groupBy("session_id", F.floor(F.col("at") / 86_400).alias("day")).agg(F.count("*").alias("stops"), F.round(F.sum("value"), 6).alias("score"))
    return first_per_key(plans, ["session_id"], F.desc(F.col("stops") >= 3), F.desc("score"), F.asc("day"))
