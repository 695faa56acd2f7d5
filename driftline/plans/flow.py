"""Queries of the core flow: whole effort segments, placed catches, session state, the eleven-key cube and its back-off."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import geo, scores
from driftline.operators import effort as E
from driftline.operators import temporal as T
from driftline.operators.relational import first_per_key
from driftline.plans.base import POINTS, mean_scale_sql, points, query

#: The given events lie hours and kilometres apart, so limits are wider here than for a real session.
GAP_S, RADIUS_M, TROLLING_MPS, WIDTH = 21_600, 4000.0, 0.5, 21_600

_STOPS = """ends AS (SELECT session_id, min(at) AS began, max(at) AS ended FROM points GROUP BY 1),
stops AS (SELECT p.session_id, point_id AS stop_id, at AS started, CASE WHEN k > 90 THEN ended + 1 ELSE at + k * 600 END AS stopped FROM points p JOIN ends USING (session_id) WHERE kind = 'signup'),
progress AS (SELECT p.session_id, point_id AS waypoint_id, row_number() OVER (PARTITION BY p.session_id ORDER BY at, point_id) AS sequence, CASE WHEN k % 4 > 0 THEN at + 300 END AS arrived, CASE WHEN k % 3 > 0 THEN at + k * 900 END AS departed, CASE WHEN k % 5 = 0 THEN at + k * 1200 END AS completed,
  CASE WHEN k % 7 = 0 THEN at + k * 2000 END AS skipped, CASE WHEN k % 8 > 0 THEN at - 1800 END AS approached, lon AS w_lon, lat AS w_lat, k % 2 = 0 AS trolling, CASE k % 6 WHEN 0 THEN 'UPCOMING' WHEN 1 THEN 'NAVIGATING' WHEN 2 THEN 'ARRIVED' WHEN 3 THEN 'FISHING' WHEN 4 THEN 'COMPLETED' ELSE 'SKIPPED' END AS status, began, ended
  FROM points p JOIN ends USING (session_id) WHERE kind = 'view' AND value > 40)"""
_PAUSED = "pauses AS (SELECT session_id, at AS paused, CASE WHEN value < 150 THEN at + 3600 * k END AS resumed FROM points WHERE kind = 'error' AND value > 120)"


def _tables(spark, d):
    p = points(spark, d)
    k, at = F.col("k"), F.col("at")
    ends = p.groupBy("session_id").agg(F.min("at").alias("began"), F.max("at").alias("ended"))
    stops = p.filter("kind = 'signup'").join(ends, "session_id").select("session_id", F.col("point_id").alias("stop_id"), at.alias("started"), F.when(k > 90, F.col("ended") + 1).otherwise(at + k * 600).alias("stopped"))
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    status = F.element_at(F.array(*map(F.lit, ("UPCOMING", "NAVIGATING", "ARRIVED", "FISHING", "COMPLETED", "SKIPPED"))), (k % 6 + 1).cast("int"))
    progress = p.filter("kind = 'view' AND value > 40").join(ends, "session_id").select(
        "session_id", F.col("point_id").alias("waypoint_id"), F.row_number().over(w).alias("sequence"), F.when(k % 4 > 0, at + 300).alias("arrived"), F.when(k % 3 > 0, at + k * 900).alias("departed"), F.when(k % 5 == 0, at + k * 1200).alias("completed"),
        F.when(k % 7 == 0, at + k * 2000).alias("skipped"), F.when(k % 8 > 0, at - 1800).alias("approached"), F.col("lon").alias("w_lon"), F.col("lat").alias("w_lat"), (k % 2 == 0).alias("trolling"), status.alias("status"), "began", "ended",
    )
    pauses = p.filter("kind = 'error' AND value > 120").select("session_id", at.alias("paused"), F.when(F.col("value") < 150, at + 3600 * k).alias("resumed"))
    return p, stops, progress, pauses


_LEFT = "coalesce(departed, completed, skipped)"


@query(f"""WITH {POINTS}, {_STOPS}, {_PAUSED}, lagged AS (SELECT session_id, point_id, lag(at) OVER w AS start, at AS "end", lon, lat, {mean_scale_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} / nullif(at - lag(at) OVER w, 0) AS speed FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)),
pairs AS (SELECT * FROM lagged l WHERE "end" > start AND NOT EXISTS (SELECT 1 FROM pauses q WHERE q.session_id = l.session_id AND (l.start + l."end") / 2 >= paused AND (resumed IS NULL OR (l.start + l."end") / 2 < resumed))),
covered AS (SELECT p.point_id, arg_min(stop_id, started * 10000000 + stop_id) AS stop_id FROM pairs p JOIN stops s ON s.session_id = p.session_id AND p."end" >= started AND p."end" < stopped GROUP BY 1),
near AS (SELECT p.point_id, arg_min(waypoint_id, sequence) FILTER (WHERE NOT (trolling AND speed > {TROLLING_MPS})) AS waypoint_id FROM pairs p JOIN progress g ON g.session_id = p.session_id AND arrived IS NOT NULL AND p."end" >= arrived AND ({_LEFT} IS NULL OR p."end" < {_LEFT}) AND {mean_scale_sql('lon', 'lat', 'w_lon', 'w_lat')} <= {RADIUS_M} GROUP BY 1),
under_way AS (SELECT DISTINCT p.point_id FROM pairs p JOIN progress g ON g.session_id = p.session_id AND NOT (arrived IS NOT NULL AND p."end" >= arrived AND ({_LEFT} IS NULL OR p."end" < {_LEFT})) AND (skipped IS NULL OR p."end" < skipped) AND (completed IS NULL OR p."end" < completed) AND (p."end" >= approached OR sequence = 1)),
drafts AS (SELECT p.session_id, start, "end", CASE WHEN "end" - start > {GAP_S} THEN 'UNKNOWN' WHEN stop_id IS NOT NULL OR waypoint_id IS NOT NULL THEN 'FISHING' WHEN u.point_id IS NOT NULL OR n.point_id IS NULL THEN 'TRAVEL' ELSE 'UNKNOWN' END AS kind,
  CASE WHEN "end" - start <= {GAP_S} AND stop_id IS NULL THEN waypoint_id END AS waypoint_id, CASE WHEN "end" - start <= {GAP_S} THEN stop_id END AS stop_id,
  CASE WHEN "end" - start > {GAP_S} THEN 0.4 WHEN stop_id IS NOT NULL OR waypoint_id IS NOT NULL THEN 1.0 WHEN u.point_id IS NOT NULL OR n.point_id IS NULL THEN 0.8 ELSE 0.5 END AS confidence
  FROM pairs p LEFT JOIN covered c ON c.point_id = p.point_id LEFT JOIN near n ON n.point_id = p.point_id LEFT JOIN under_way u ON u.point_id = p.point_id
  UNION ALL SELECT session_id, arrived, coalesce({_LEFT}, ended), 'FISHING', waypoint_id, NULL, 0.6 FROM progress g WHERE coalesce({_LEFT}, ended) > arrived AND NOT EXISTS (SELECT 1 FROM points x WHERE x.session_id = g.session_id AND x.at BETWEEN arrived AND coalesce({_LEFT}, ended))
    AND NOT EXISTS (SELECT 1 FROM pauses q WHERE q.session_id = g.session_id AND (arrived + coalesce({_LEFT}, ended)) / 2 >= paused AND (resumed IS NULL OR (arrived + coalesce({_LEFT}, ended)) / 2 < resumed))
  UNION ALL SELECT session_id, started, stopped, 'FISHING', NULL, stop_id, 1.0 FROM stops s WHERE stopped > started AND NOT EXISTS (SELECT 1 FROM points x WHERE x.session_id = s.session_id AND x.at BETWEEN started AND stopped)
    AND NOT EXISTS (SELECT 1 FROM pauses q WHERE q.session_id = s.session_id AND (started + stopped) / 2 >= paused AND (resumed IS NULL OR (started + stopped) / 2 < resumed))),
marked AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(waypoint_id) OVER w IS NOT DISTINCT FROM waypoint_id AND lag("end") OVER w = start THEN 0 ELSE 1 END AS fresh FROM drafts WINDOW w AS (PARTITION BY session_id ORDER BY start, "end", kind, waypoint_id NULLS FIRST, stop_id NULLS FIRST)),
numbered AS (SELECT *, sum(fresh) OVER w AS island, row_number() OVER w AS place FROM marked WINDOW w AS (PARTITION BY session_id ORDER BY start, "end", kind, waypoint_id NULLS FIRST, stop_id NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT session_id, kind, waypoint_id, min(start) AS start, arg_max("end", place) AS "end", first(stop_id ORDER BY place) AS stop_id, CAST(max(confidence) AS DOUBLE) AS confidence FROM numbered GROUP BY session_id, island, kind, waypoint_id""")
def alg_effort_segments(spark, d):
    """Effort with all seven branches, merged."""
    p, stops, progress, pauses = _tables(spark, d)
    pairs = E.point_pairs(p).join(p.select("point_id", "lon", "lat"), "point_id")
    found = E.whole_effort(pairs, p, pauses, stops, progress, max_gap_s=GAP_S, radius_m=RADIUS_M, max_trolling_mps=TROLLING_MPS, width=WIDTH)
    return found.select("session_id", "kind", "waypoint_id", "start", "end", "stop_id", "confidence")


_RANKED = "CASE WHEN status IN ('NAVIGATING', 'ARRIVED', 'FISHING') THEN 0 WHEN status = 'UPCOMING' THEN 1 ELSE 2 END"


@query(f"""WITH {POINTS}, {_STOPS}, catches AS (SELECT session_id, point_id AS catch_id, at, CASE WHEN k % 9 > 0 THEN lon END AS lon, CASE WHEN k % 9 > 0 THEN lat END AS lat, CASE WHEN k % 3 = 0 THEN (SELECT max(waypoint_id) FROM progress g WHERE g.session_id = p.session_id) END AS said FROM points p WHERE kind = 'purchase'),
targets AS (SELECT session_id, min(waypoint_id) AS target_id FROM progress WHERE session_id % 2 = 0 GROUP BY 1), active AS (SELECT session_id, arg_min(waypoint_id, sequence) AS active_id FROM progress WHERE {_RANKED} = 0 GROUP BY 1),
found AS (SELECT c.session_id, catch_id, 1 AS step, 0 AS rank, 0.0 AS metres, sequence, 'CURRENT_WAYPOINT' AS method, waypoint_id AS place FROM catches c JOIN progress g ON g.session_id = c.session_id AND said = waypoint_id AND c.at BETWEEN began AND ended AND (skipped IS NULL OR c.at < skipped) AND (completed IS NULL OR c.at < completed)
  UNION ALL SELECT c.session_id, catch_id, 2, 0, 0.0, started, 'AD_HOC_STOP', stop_id FROM catches c JOIN stops s ON s.session_id = c.session_id AND said IS NULL AND c.at >= started AND c.at < stopped
  UNION ALL SELECT * FROM (SELECT c.session_id, catch_id, CASE WHEN waypoint_id = target_id AND {_RANKED} < 2 THEN 3 WHEN waypoint_id = active_id THEN 4 ELSE 5 END, {_RANKED}, {mean_scale_sql('lon', 'lat', 'w_lon', 'w_lat')} AS metres, sequence, 'NEAREST_WAYPOINT', waypoint_id FROM catches c JOIN progress g ON g.session_id = c.session_id LEFT JOIN targets t ON t.session_id = c.session_id LEFT JOIN active a ON a.session_id = c.session_id) WHERE metres <= {RADIUS_M}),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY catch_id ORDER BY step, rank, metres, sequence, place) = 1)
SELECT c.session_id, c.catch_id, coalesce(method, 'UNASSOCIATED') AS method, place FROM catches c LEFT JOIN best b ON b.catch_id = c.catch_id""")
def join_catch_cascade(spark, d):
    p, stops, progress, _ = _tables(spark, d)
    last = progress.groupBy("session_id").agg(F.max("waypoint_id").alias("last_id"))
    there = F.col("k") % 9 > 0
    catches = p.filter("kind = 'purchase'").join(last, "session_id", "left").select("session_id", F.col("point_id").alias("catch_id"), "at", F.when(there, F.col("lon")).alias("lon"), F.when(there, F.col("lat")).alias("lat"), F.when(F.col("k") % 3 == 0, F.col("last_id")).alias("said"))
    targets = progress.filter("session_id % 2 = 0").groupBy("session_id").agg(F.min("waypoint_id").alias("target_id"))
    return E.associated_catches(catches, stops, progress, targets, radius_m=RADIUS_M, width=WIDTH)


_NOW = 1_706_659_200  # the end of the given month


@query(f"""WITH {POINTS}, {_STOPS}, hops AS (SELECT session_id, {mean_scale_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS m FROM points WHERE value < 60 WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)),
travelled AS (SELECT session_id, sum(m) AS m FROM hops GROUP BY 1), latest AS (SELECT session_id, lon, lat FROM points WHERE value < 60 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at DESC, point_id DESC) = 1),
current AS (SELECT session_id, waypoint_id, arrived, status, w_lon, w_lat FROM progress WHERE status IN ('NAVIGATING', 'ARRIVED', 'FISHING') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence) = 1),
since AS (SELECT session_id, max(at) FILTER (WHERE kind = 'view') AS since FROM points GROUP BY 1), signal AS (SELECT p.session_id, max(at) AS signal FROM points p JOIN since s ON s.session_id = p.session_id WHERE kind IN ('click', 'error') AND at >= since GROUP BY 1)
SELECT e.session_id, round(coalesce(l.lon, w_lon, -79), 6) AS lon, round(coalesce(l.lat, w_lat, 44), 6) AS lat, round(greatest(0, 100000 - coalesce(m, 0)), 3) AS range_m, c.waypoint_id, CASE WHEN arrived IS NOT NULL THEN greatest(0, ({_NOW} - arrived) // 60) WHEN status = 'NAVIGATING' THEN 0 ELSE NULL END AS at_waypoint_min,
  CASE WHEN status = 'FISHING' THEN greatest(0, ({_NOW} - coalesce(signal, since, began)) // 60) ELSE 0 END AS no_bite_min
FROM ends e LEFT JOIN travelled t ON t.session_id = e.session_id LEFT JOIN latest l ON l.session_id = e.session_id LEFT JOIN current c ON c.session_id = e.session_id LEFT JOIN since s ON s.session_id = e.session_id LEFT JOIN signal g ON g.session_id = e.session_id""")
def alg_session_state(spark, d):
    """Position with its fall-backs, range left, minutes at the waypoint and without a signal, as of one moment."""
    p, _, progress, _ = _tables(spark, d)
    accepted = p.filter("value < 60")
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    hop = geo.mean_scale_distance(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat")
    order = F.struct("at", "point_id")
    travelled = accepted.withColumn("m", hop).groupBy("session_id").agg(F.sum("m").alias("m"), F.max_by(F.struct("lon", "lat"), order).alias("last"))
    current = first_per_key(progress.filter("status IN ('NAVIGATING', 'ARRIVED', 'FISHING')"), ["session_id"], F.asc("sequence")).select("session_id", "waypoint_id", "arrived", "status", "w_lon", "w_lat")
    kind = F.col("kind")
    events = p.groupBy("session_id").agg(F.min("at").alias("began"), F.max(F.when(kind == "view", F.col("at"))).alias("since"), F.max(F.when(kind.isin("click", "error"), F.col("at"))).alias("last_signal"))
    signal = F.when(F.col("last_signal") >= F.col("since"), F.col("last_signal"))
    minutes = lambda t: F.greatest(F.lit(0), F.floor((F.lit(_NOW) - t) / 60)).cast("long")
    s = events.join(travelled, "session_id", "left").join(current, "session_id", "left")
    return s.select(
        "session_id", F.round(F.coalesce("last.lon", "w_lon", F.lit(-79.0)), 6).alias("lon"), F.round(F.coalesce("last.lat", "w_lat", F.lit(44.0)), 6).alias("lat"), F.round(F.greatest(F.lit(0.0), 100_000 - F.coalesce("m", F.lit(0.0))), 3).alias("range_m"), "waypoint_id",
        F.when(F.col("arrived").isNotNull(), minutes(F.col("arrived"))).when(F.col("status") == "NAVIGATING", 0).alias("at_waypoint_min"), F.when(F.col("status") == "FISHING", minutes(F.coalesce(signal, "since", "began"))).otherwise(0).alias("no_bite_min"),
    )


# --- the cube

#: Keys of a grain; null is an unknown dimension, and groups with itself.
GRAIN = ("lake", "session_waypoint", "trip_waypoint", "species", "season", "time_bucket", "structure", "wind", "wind_direction", "lure", "version")
_COUNTS = ("effort_s", "bites", "fish_on", "landed")
_BOUNDS = (0, 5, 7, 11, 14, 17, 20)

_LOCAL = "at - 3600 * (4 + session_id % 3)"
_BUCKET = "CASE WHEN {h} >= 20 THEN 'NIGHT' WHEN {h} >= 17 THEN 'EVENING' WHEN {h} >= 14 THEN 'AFTERNOON' WHEN {h} >= 11 THEN 'MIDDAY' WHEN {h} >= 7 THEN 'MORNING' WHEN {h} >= 5 THEN 'DAWN' ELSE 'NIGHT' END"
_CUBE = f"""{POINTS}, lured AS (SELECT session_id, at, max(k) % 4 AS lure FROM points WHERE kind = 'signup' GROUP BY 1, 2), blown AS (SELECT session_id, at, max(value) AS wind FROM points WHERE kind = 'error' GROUP BY 1, 2),
keyed AS (SELECT p.*, lure, wind AS kph FROM points p ASOF LEFT JOIN lured l ON p.session_id = l.session_id AND p.at >= l.at ASOF LEFT JOIN blown b ON p.session_id = b.session_id AND p.at >= b.at),
cut AS (SELECT *, unnest(list_sort(list_concat([{_LOCAL}], list_filter(flatten(list_transform(range(({_LOCAL}) // 86400, ({_LOCAL} + 60 * (k + 1) * 8) // 86400 + 1), lambda day: list_transform([{', '.join(map(str, _BOUNDS))}], lambda h: day * 86400 + h * 3600))), lambda b: b > {_LOCAL} AND b < {_LOCAL} + 60 * (k + 1) * 8)))) AS part_start FROM keyed WHERE kind = 'view'),
parts AS (SELECT *, coalesce(lead(part_start) OVER (PARTITION BY point_id ORDER BY part_start), {_LOCAL} + 60 * (k + 1) * 8) - part_start AS seconds FROM cut),
contributions AS (SELECT *, seconds AS effort_s, 0 AS bites, 0 AS fish_on, 0 AS landed, part_start AS local FROM parts UNION ALL BY NAME SELECT *, 0 AS effort_s, (kind = 'click') :: INT AS bites, (kind = 'error') :: INT AS fish_on, (kind = 'purchase') :: INT AS landed, {_LOCAL} AS local FROM keyed WHERE kind IN ('click', 'error', 'purchase')),
grains AS (SELECT session_id % 5 AS lake, session_id AS session_waypoint, k % 6 AS trip_waypoint, session_id % 2 AS species, CASE WHEN month(make_timestamp(local * 1000000)) IN (3, 4, 5) THEN 'SPRING' WHEN month(make_timestamp(local * 1000000)) IN (6, 7, 8) THEN 'SUMMER' WHEN month(make_timestamp(local * 1000000)) IN (9, 10, 11) THEN 'FALL' ELSE 'WINTER' END AS season,
  {_BUCKET.format(h='local // 3600 % 24')} AS time_bucket, k % 3 AS structure, CASE WHEN kph < 10 THEN 'CALM' WHEN kph < 25 THEN 'MODERATE' WHEN kph IS NOT NULL THEN 'STRONG' END AS wind, CASE WHEN kph IS NOT NULL THEN CAST(floor(kph) AS BIGINT) % 4 END AS wind_direction, lure, 1 AS version, effort_s, bites, fish_on, landed FROM contributions)"""


def _grains(spark, d):
    """Contributions by grain: effort cut at the local bounds of its time buckets, events with the lure and wind of their time."""
    p = points(spark, d)
    of = lambda kind: p.filter(F.col("kind") == kind)
    lured = of("signup").groupBy("session_id", F.col("at").alias("t")).agg((F.max("k") % 4).alias("lure"))
    blown = of("error").groupBy("session_id", F.col("at").alias("t")).agg(F.max("value").alias("kph"))
    keyed = T.as_of(T.as_of(p, lured, ["session_id"], "at", "t", "t", ["lure"], ""), blown, ["session_id"], "at", "t", "t", ["kph"], "")
    # Each lake has its own zone, and hours and months are local ones.
    zone = F.concat(F.lit("-0"), (4 + F.col("session_id") % 3).cast("string"), F.lit(":00"))
    local = F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds("at"), zone))
    keyed = keyed.withColumn("local", local)
    k, kind = F.col("k"), F.col("kind")
    spans = keyed.filter("kind = 'view'").withColumn("until", F.col("local") + 60 * (k + 1) * 8)
    days = F.sequence(F.floor(F.col("local") / 86_400), F.floor(F.col("until") / 86_400))
    bounds = F.flatten(F.transform(days, lambda day: F.transform(F.array(*map(F.lit, _BOUNDS)), lambda h: day * 86_400 + h * 3600)))
    parts = T.split_at(spans, "local", "until", bounds).withColumn("effort_s", F.col("part_end") - F.col("part_start")).withColumn("local", F.col("part_start"))
    effort = parts.select(*keyed.columns, "effort_s", *[F.lit(0).alias(c) for c in _COUNTS[1:]])
    events = keyed.filter(kind.isin("click", "error", "purchase")).select(*keyed.columns, F.lit(0).alias("effort_s"), *[(kind == n).cast("int").alias(c) for c, n in zip(_COUNTS[1:], ("click", "error", "purchase"))])
    rows = effort.unionByName(events)
    month = F.month(F.timestamp_seconds("local"))
    return rows.select(
        (F.col("session_id") % 5).alias("lake"), F.col("session_id").alias("session_waypoint"), (k % 6).alias("trip_waypoint"), (F.col("session_id") % 2).alias("species"), scores.season(month).alias("season"), scores.time_bucket(F.floor(F.col("local") / 3600) % 24).alias("time_bucket"),
        (k % 3).alias("structure"), scores.wind_bucket("kph").alias("wind"), (F.floor("kph") % 4).alias("wind_direction"), "lure", F.lit(1).alias("version"), *_COUNTS,
    )


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTS)


@query(f"WITH {_CUBE} SELECT {', '.join(GRAIN)}, {_SUMS} FROM grains GROUP BY ALL")
def agg_grain_cube(spark, d):
    """Sums of eleven-key grains."""
    return _grains(spark, d).groupBy(*GRAIN).agg(*[F.sum(c).alias(c) for c in _COUNTS])


@query(f"""WITH {_CUBE}, asked AS (SELECT DISTINCT lake, species, season, trip_waypoint, structure, lure FROM grains), n AS (SELECT lake, species, season, trip_waypoint, structure, lure, session_waypoint, effort_s, landed FROM grains), levels AS (
SELECT a.*, 1 AS level, sum(effort_s) AS effort_s, sum(n.landed) AS landed, count(DISTINCT session_waypoint) AS waypoints FROM asked a JOIN n ON n.lake = a.lake AND n.species = a.species AND n.season = a.season AND n.trip_waypoint = a.trip_waypoint AND n.lure = a.lure GROUP BY ALL
UNION ALL SELECT a.*, 2, sum(effort_s), sum(n.landed), count(DISTINCT session_waypoint) FROM asked a JOIN n ON n.lake = a.lake AND n.species = a.species AND n.season = a.season AND n.trip_waypoint = a.trip_waypoint GROUP BY ALL
UNION ALL SELECT a.*, 3, sum(effort_s), sum(n.landed), count(DISTINCT session_waypoint) FROM asked a JOIN n ON n.lake = a.lake AND n.species = a.species AND n.season = a.season AND n.structure = a.structure GROUP BY ALL
UNION ALL SELECT a.*, 4, sum(effort_s), sum(n.landed), count(DISTINCT session_waypoint) FROM asked a JOIN n ON n.lake = a.lake AND n.species = a.species AND n.season = a.season GROUP BY ALL)
SELECT lake, species, season, trip_waypoint, structure, lure, level, CAST(effort_s AS BIGINT) AS effort_s, CAST(landed AS BIGINT) AS landed, waypoints FROM levels WHERE level = 4 OR (waypoints >= 3 AND effort_s / 3600.0 / (effort_s / 3600.0 + 4) >= 0.25) QUALIFY row_number() OVER (PARTITION BY lake, species, season, trip_waypoint, structure, lure ORDER BY level) = 1""")
def agg_backoff(spark, d):
    """The finest of four levels with enough evidence: waypoint and lure, waypoint, structure, then lake, species and season.

    The finest sums are taken once, and each coarser level is a sum of those.
    """
    base = ["lake", "species", "season"]
    finest = [*base, "trip_waypoint", "structure", "lure"]
    grains = _grains(spark, d).groupBy(*finest, "session_waypoint").agg(F.sum("effort_s").alias("effort_s"), F.sum("landed").alias("landed"))
    asked = grains.select(*finest).distinct()
    out, hours = asked, F.col("effort_s") / 3600.0
    for level, keys in enumerate((["trip_waypoint", "lure"], ["trip_waypoint"], ["structure"], []), start=1):
        sums = grains.groupBy(*base, *keys).agg(F.sum("effort_s").alias("effort_s"), F.sum("landed").alias("landed"), F.count_distinct("session_waypoint").alias("waypoints"))
        enough = F.lit(True) if level == 4 else (F.col("waypoints") >= 3) & (hours / (hours + 4) >= 0.25)
        out = out.join(sums.select(*base, *keys, F.when(enough, F.struct(F.lit(level).alias("level"), "effort_s", "landed", "waypoints")).alias(f"found_{level}")), [*base, *keys], "left")
    return out.select(*finest, F.coalesce(*[f"found_{i}" for i in range(1, 5)]).alias("f")).select(*finest, "f.level", "f.effort_s", "f.landed", "f.waypoints")


@query(f"""WITH {POINTS}, w AS (SELECT session_id, k % 5 AS spot, count(*) FILTER (WHERE kind = 'purchase') AS landed, count(*) FILTER (WHERE kind = 'error') AS lost,
  count(*) FILTER (WHERE kind NOT IN ('purchase', 'error', 'view')) AS pending, coalesce(sum(k * 60) FILTER (WHERE kind = 'view'), 0) AS effort FROM points GROUP BY 1, 2),
s AS (SELECT *, effort / 3600.0 AS h, (landed + 2.0) / (effort / 3600.0 + 4) AS posterior FROM w), r AS (SELECT *, CASE WHEN h >= 0.25 THEN round(0.5 + h / (h + 4) * (least(greatest(0.5 + 0.5 * tanh((posterior - 0.5) / 0.5), 0), 1) - 0.5), 9) END AS smoothed FROM s)
SELECT session_id, CAST(sum(landed) AS BIGINT) AS landed, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(effort) AS BIGINT) AS effort,
  round(sum(landed) * 3600.0 / nullif(sum(effort), 0), 6) AS cpue, first(spot ORDER BY smoothed DESC, spot) FILTER (WHERE smoothed IS NOT NULL) AS best_spot FROM r GROUP BY 1""")
def agg_session_perf(spark, d):
    """Catches and effort of a session, and the spot with the best smoothed score of enough effort; the first wins a tie."""
    kind = F.col("kind")
    spots = points(spark, d).groupBy("session_id", (F.col("k") % 5).alias("spot")).agg(
        F.count_if(kind == "purchase").alias("landed"), F.count_if(kind == "error").alias("lost"), F.count_if(~kind.isin("purchase", "error", "view")).alias("pending"),
        F.coalesce(F.sum(F.when(kind == "view", F.col("k") * 60)), F.lit(0)).alias("effort"),
    )
    hours = F.col("effort") / 3600.0
    smoothed = F.when(hours >= scores.MIN_HOURS, F.struct(F.round(scores.shrinkage("landed", hours)["score"], 9).alias("score"), (-F.col("spot")).alias("first")))
    total = {c: F.sum(c) for c in ("landed", "lost", "pending", "effort")}
    return spots.groupBy("session_id").agg(*[s.alias(c) for c, s in total.items()], F.round(scores.rate(total["landed"] * 3600.0, total["effort"]), 6).alias("cpue"), F.max_by("spot", smoothed).alias("best_spot"))
