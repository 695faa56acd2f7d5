"""Queries of spatial joins, scores and composed algorithms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import geo, scores
from driftline.operators import spatial as S
from driftline.operators.relational import first_per_key
from driftline.plans.base import POINTS, points, query, table

#: All positions lie south of this latitude.
MAX_LAT = 44.2


def _axis_sql(lon1, lat1, lon2, lat2):
    return f"sqrt(pow(({lon2} - {lon1}) * 111320.0 * cos(radians(({lat1} + {lat2}) / 2)), 2) + pow(({lat2} - {lat1}) * 111320.0, 2))"


@query(f"WITH {POINTS} SELECT a.point_id AS catch_id, b.point_id AS feature_id, round({_axis_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS metres FROM points a JOIN points b ON a.kind = 'purchase' AND b.kind = 'signup' AND a.session_id = b.session_id AND {_axis_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 900")
def join_dwithin_join(spark, d):
    p = points(spark, d).select("session_id", "point_id", "lon", "lat", "kind")
    met = S.within_radius(p.filter("kind = 'purchase'"), p.filter("kind = 'signup'"), 900, MAX_LAT, ("session_id",))
    return met.select(F.col("l_point_id").alias("catch_id"), F.col("r_point_id").alias("feature_id"), F.round("metres", 3).alias("metres"))


@query(f"WITH {POINTS}, near AS (SELECT point_id, kind, {_axis_sql('lon', 'lat', '-78.95', '44.05')} AS metres FROM points WHERE kind IN ('view', 'click', 'purchase')) SELECT point_id, kind, round(metres, 3) AS metres FROM near WHERE metres <= 1500 ORDER BY near.metres, point_id LIMIT 50")
def join_nearby_union(spark, d):
    p = points(spark, d)
    within = lambda kind: p.filter(F.col("kind") == kind).withColumn("metres", geo.axis_distance("lon", "lat", F.lit(-78.95), F.lit(44.05))).filter("metres <= 1500")
    rows = within("view").unionByName(within("click")).unionByName(within("purchase"))
    return rows.orderBy("metres", "point_id").limit(50).select("point_id", "kind", F.round("metres", 3).alias("metres"))


#: A closed area with a notch.
RING = ((-78.98, 44.01), (-78.92, 44.01), (-78.92, 44.08), (-78.95, 44.04), (-78.98, 44.08))
_RING_SQL = " + ".join(f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - ({x1})) * (lat - {y1}) / ({y2} - {y1} + 0.0) + ({x1}) THEN 1 ELSE 0 END)" if y1 != y2 else "0" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]))


def _ring():
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])


@query(f"WITH {POINTS} SELECT point_id, ({_RING_SQL}) % 2 = 1 AS inside FROM points")
def geo_contains(spark, d):
    return points(spark, d).select("point_id", geo.in_ring("lon", "lat", _ring()).alias("inside"))


@query(f"WITH {POINTS}, v AS (SELECT *, ({_RING_SQL}) % 2 = 1 AS inside FROM points) SELECT CASE WHEN inside AND kind = 'error' THEN 'AREA_CLOSED' WHEN inside AND kind = 'click' THEN 'PRIMARY_CLOSED' WHEN inside AND kind = 'view' THEN 'SECONDARY_WARNING' ELSE 'ACCEPTED' END AS verdict, count(*) AS n FROM v GROUP BY 1")
def flt_regulation(spark, d):
    inside, kind = geo.in_ring("lon", "lat", _ring()), F.col("kind")
    verdict = F.when(inside & (kind == "error"), "AREA_CLOSED").when(inside & (kind == "click"), "PRIMARY_CLOSED").when(inside & (kind == "view"), "SECONDARY_WARNING").otherwise("ACCEPTED")
    return points(spark, d).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT 'e' || CAST(CAST(floor((lon + 79.0) / (2000 / (111320.0 * cos(radians(44.0))))) AS BIGINT) AS VARCHAR) || ':n' || CAST(CAST(floor((lat - 44.0) / (2000 / 111320.0)) AS BIGINT) AS VARCHAR) AS region, count(*) AS n FROM points GROUP BY 1")
def top_region_key(spark, d):
    return points(spark, d).groupBy(S.region_key("lon", "lat", -79.0, 44.0, 2000).alias("region")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT CAST(floor(lon / (500 / (111320.0 * cos(radians(44.2))))) AS BIGINT) AS cell_x, CAST(floor(lat / (500 / 111320.0)) AS BIGINT) AS cell_y, CAST(-max(CASE WHEN value = top THEN -point_id END) AS BIGINT) AS point_id, max(value) AS value FROM (SELECT *, max(value) OVER (PARTITION BY floor(lon / (500 / (111320.0 * cos(radians(44.2))))), floor(lat / (500 / 111320.0))) AS top FROM points) GROUP BY 1, 2")
def ddp_best_per_cell(spark, d):
    return S.best_per_cell(points(spark, d), 500, MAX_LAT, "value", "point_id")


@query(f"WITH RECURSIVE {POINTS}, ranked AS (SELECT session_id, point_id, lon, lat, value, row_number() OVER (PARTITION BY session_id ORDER BY value DESC, point_id) AS i FROM points WHERE kind = 'signup'), walk AS (SELECT DISTINCT session_id, 0 :: BIGINT AS i, [] :: STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM ranked UNION ALL SELECT w.session_id, r.i, CASE WHEN len(list_filter(kept, lambda q: {_axis_sql('q.x', 'q.y', 'r.lon', 'r.lat')} <= 900)) = 0 THEN list_append(kept, {{'id': r.point_id, 'x': r.lon, 'y': r.lat}}) ELSE kept END FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.i = w.i + 1), ended AS (SELECT session_id, unnest(arg_max(kept, i)).id AS id FROM walk GROUP BY 1) SELECT r.session_id, point_id, lon, lat, value FROM ranked r JOIN ended e ON e.id = r.point_id")
def ddp_greedy_spatial(spark, d):
    """The rows that a walk by falling value keeps, if it has kept none near them."""
    p = points(spark, d).filter("kind = 'signup'").select("session_id", "point_id", "lon", "lat", "value")
    return S.greedy_spacing(p, "point_id", "value", 900, MAX_LAT, ("session_id",))


_STEP = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(r.lat - w.lat) / 2), 2) + cos(radians(w.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - w.lon) / 2), 2)))) >= 3000"


@query(f"WITH RECURSIVE {POINTS}, ranked AS (SELECT session_id, point_id, lon, lat, kind = 'purchase' AS anchor, row_number() OVER (PARTITION BY session_id ORDER BY at, point_id) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM points), walk AS (SELECT session_id, i, point_id, lon, lat, true AS keep FROM ranked WHERE i = 1 UNION ALL SELECT r.session_id, r.i, r.point_id, CASE WHEN NOT r.anchor AND r.i < r.n AND {_STEP} THEN r.lon ELSE w.lon END, CASE WHEN NOT r.anchor AND r.i < r.n AND {_STEP} THEN r.lat ELSE w.lat END, r.n <= 2 OR r.i = r.n OR r.anchor OR {_STEP} FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.i = w.i + 1) SELECT session_id, point_id FROM walk WHERE keep")
def smp_trace_thin(spark, d):
    """First, last and anchor points, and others far enough from the last ordinary one kept."""
    p = points(spark, d).withColumn("anchor", F.col("kind") == "purchase")
    return S.thin_trace(p, "anchor", 3000.0).select("session_id", "point_id")


# --- scores


@query("SELECT p_partkey, round(least(greatest(0.35 * least(p_size / 50.0, 1) + 0.25 * greatest(0, 1 - greatest(10 - p_size, p_size - 30, 0) / 5.0) + 0.2 * least(p_retailprice / 2000, 1) + 0.1 * CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.5 END + 0.1 * 0.5, 0), 1), 6) AS score FROM part")
def alg_spot_score(spark, d):
    terms = 0.35 * scores.clamp01(F.col("p_size") / F.lit(50.0)) + 0.25 * scores.depth_match("p_size", F.lit(10), F.lit(30), 5.0) + 0.2 * scores.clamp01(F.col("p_retailprice") / 2000) + 0.1 * F.when(F.col("p_type") == "ECONOMY", 1.0).otherwise(0.5) + 0.1 * 0.5
    return table(spark, d, "part").select("p_partkey", F.round(scores.clamp01(terms), 6).alias("score"))


@query(f"WITH {POINTS}, a AS (SELECT point_id, abs((k * 3.6 - 90 + 540) % 360 - 180) AS d FROM points) SELECT point_id, round(CASE WHEN d <= 45 THEN -0.35 WHEN d >= 135 THEN 0.6 ELSE 0.15 END * 0.8, 6) AS effect FROM a")
def alg_wind_effect(spark, d):
    return points(spark, d).select("point_id", F.round(scores.wind_effect(F.col("k") * 3.6, F.lit(90.0), F.lit(0.8)), 6).alias("effect"))


@query("SELECT event_id, round(least(1.0, greatest(0.0, (value - 20) / 60.0)), 6) AS penalty FROM events")
def alg_boat_penalty(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.linear_penalty("value", 20.0, 80.0), 6).alias("penalty"))


@query("SELECT event_id, round((1 - least(1.0, abs(value - 18) / 20) - 0.5) * 2 * 0.7, 6) AS effect FROM events")
def alg_temperature(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.temperature_effect("value", F.lit(0.7)), 6).alias("effect"))


@query(f"WITH {POINTS} SELECT point_id, round(CASE WHEN k - 20 <= 0 THEN 0 ELSE coalesce(CASE WHEN kind = 'view' THEN least(1.0, greatest(0.0, (value - 50) / 550.0)) END, CASE WHEN kind = 'click' THEN 1 - k / 100.0 END, 0.5) * sin(radians(k - 20)) END, 6) AS influence FROM points")
def alg_solar_influence(spark, d):
    kind, k = F.col("kind"), F.col("k")
    return points(spark, d).select("point_id", F.round(scores.solar_influence(k - 20, F.when(kind == "view", F.col("value")), F.when(kind == "click", k)), 6).alias("influence"))


@query("WITH s AS (SELECT o_orderkey, o_totalprice / 500000 AS u, unnest(range(0, CAST(ceil((o_orderkey % 60 + 1) / 15.0) AS BIGINT))) AS i FROM orders) SELECT o_orderkey, round(sum(u * pow(0.8, i)), 6) AS total FROM s GROUP BY 1")
def alg_dwell_value(spark, d):
    slots = F.ceil((F.col("o_orderkey") % 60 + 1) / F.lit(15.0)).cast("int")
    s = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("u"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("i"))
    return s.groupBy("o_orderkey").agg(F.round(F.sum(F.col("u") * F.pow(F.lit(0.8), F.col("i"))), 6).alias("total"))


@query(f"WITH {POINTS} SELECT session_id, round(avg(CASE WHEN kind = 'view' THEN value END), 6) AS wind, CAST(coalesce(sum(CASE WHEN kind = 'error' THEN k END), 0) AS BIGINT) AS rain, arg_max(k, at * 10000000 + point_id) FILTER (WHERE kind = 'click') AS direction FROM points GROUP BY 1")
def alg_weather_summary(spark, d):
    is_kind = lambda kind, c: F.when(F.col("kind") == kind, c)
    order = F.struct("at", "point_id")
    return points(spark, d).groupBy("session_id").agg(F.round(F.avg(is_kind("view", F.col("value"))), 6).alias("wind"), F.coalesce(F.sum(is_kind("error", F.col("k"))), F.lit(0)).alias("rain"), F.max_by("k", is_kind("click", order)).alias("direction"))


@query(f"WITH {POINTS}, t AS (SELECT unnest(['click', 'view', 'purchase', 'error', 'signup', 'hump']) AS type) SELECT type, count(session_id) AS n, round(avg(k / 100.0), 4) AS mean_confidence, count(*) FILTER (WHERE k < 25) AS q1, count(*) FILTER (WHERE k >= 25 AND k < 50) AS q2, count(*) FILTER (WHERE k >= 50 AND k < 75) AS q3, count(*) FILTER (WHERE k >= 75) AS q4 FROM t LEFT JOIN points ON type = kind GROUP BY 1")
def alg_quality_report(spark, d):
    types = spark.createDataFrame([(t,) for t in ("click", "view", "purchase", "error", "signup", "hump")], "type string")
    k = F.col("k")
    sums = points(spark, d).groupBy(F.col("kind").alias("type")).agg(F.count("*").alias("n"), F.round(F.avg(k / 100.0), 4).alias("mean_confidence"), F.count_if(k < 25).alias("q1"), F.count_if((k >= 25) & (k < 50)).alias("q2"), F.count_if((k >= 50) & (k < 75)).alias("q3"), F.count_if(k >= 75).alias("q4"))
    return types.join(sums, "type", "left").na.fill(0, ["n", "q1", "q2", "q3", "q4"])


@query(f"WITH {POINTS} SELECT session_id, point_id, lon, lat FROM points QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at DESC, point_id DESC) = 1")
def stm_live_projection(spark, d):
    return first_per_key(points(spark, d), ["session_id"], F.desc("at"), F.desc("point_id")).select("session_id", "point_id", "lon", "lat")
