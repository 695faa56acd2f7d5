"""Queries of effort, as-of and range joins, windows, attribution and the performance cube."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.scores import rate, season, shrinkage, time_bucket, wind_bucket
from driftline.operators import attribution as A
from driftline.operators import effort as E
from driftline.operators import temporal as T
from driftline.operators.relational import first_per_key
from driftline.plans.base import POINTS, mean_scale_sql, points, query

#: The given events lie hours apart, so a gap is longer here than for positions of a real session.
GAP_S = 21_600

_FLAGGED = f"""{POINTS}, lagged AS (SELECT *, lag(at) OVER w AS p_at, {mean_scale_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS moved FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)),
flagged AS (SELECT session_id, point_id, at, lon, lat, kind, value, k, CASE WHEN k > 90 OR (abs(at - p_at) = 0 AND moved > 1) OR moved / nullif(abs(at - p_at), 0) > 40 THEN 'LOW_QUALITY' ELSE 'ACCEPTED' END AS quality FROM lagged)"""
_PAIRS = f"""{_FLAGGED}, paired AS (SELECT session_id, point_id, lag(at) OVER w AS start, at AS "end", {mean_scale_sql('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS distance FROM flagged WHERE quality = 'ACCEPTED' WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)),
pairs AS (SELECT *, "end" - start AS dt, distance / ("end" - start) AS speed FROM paired WHERE "end" > start)"""
_SEGMENTS = f"""{_PAIRS}, typed AS (SELECT *, CASE WHEN dt > {GAP_S} THEN 'UNKNOWN' WHEN speed <= 0.4 THEN 'FISHING' ELSE 'TRAVEL' END AS kind FROM pairs),
marked AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind OR lag("end") OVER w <> start THEN 1 ELSE 0 END AS fresh FROM typed WINDOW w AS (PARTITION BY session_id ORDER BY start, "end")),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
segments AS (SELECT session_id, island, kind, min(start) AS start, max("end") AS "end", CAST(sum(dt) AS BIGINT) AS seconds, CASE kind WHEN 'UNKNOWN' THEN 0.4 WHEN 'FISHING' THEN 1.0 ELSE 0.8 END :: DOUBLE AS confidence FROM numbered GROUP BY 1, 2, 3)"""


def _flagged(spark, d):
    return E.quality_flags(points(spark, d), "k", max_accuracy=90)


def _segments(spark, d):
    return E.effort_segments(E.point_pairs(_flagged(spark, d).filter("quality = 'ACCEPTED'")), max_gap_s=GAP_S)


@query(f"WITH {_FLAGGED} SELECT session_id, point_id, quality FROM flagged")
def win_quality_flag(spark, d):
    return _flagged(spark, d).select("session_id", "point_id", "quality")


@query(f"WITH {_PAIRS} SELECT session_id, point_id, dt, round(distance, 4) AS distance, round(speed, 6) AS speed FROM pairs")
def win_lag_pairs(spark, d):
    pairs = E.point_pairs(_flagged(spark, d).filter("quality = 'ACCEPTED'"))
    return pairs.select("session_id", "point_id", "dt", F.round("distance", 4).alias("distance"), F.round("speed", 6).alias("speed"))


_PERF = f"""{_SEGMENTS}, effort AS (SELECT session_id, CAST(sum(CASE WHEN kind = 'FISHING' THEN seconds ELSE 0 END) AS BIGINT) AS fishing_s, CAST(sum(CASE WHEN kind = 'TRAVEL' THEN seconds ELSE 0 END) AS BIGINT) AS travel_s, CAST(sum(CASE WHEN kind = 'UNKNOWN' THEN seconds ELSE 0 END) AS BIGINT) AS unknown_s, count(*) AS n_segments FROM segments GROUP BY 1),
landed AS (SELECT session_id, count(*) AS landed FROM points WHERE kind = 'purchase' GROUP BY 1),
rated AS (SELECT e.*, coalesce(landed, 0) AS landed, fishing_s / 3600.0 AS h FROM effort e LEFT JOIN landed l ON e.session_id = l.session_id),
posted AS (SELECT *, CASE WHEN h >= 0.25 THEN (landed + 2.0) / (h + 4) ELSE 0.5 END AS p, CASE WHEN h >= 0.25 THEN h / (h + 4) ELSE 0.0 END AS confidence FROM rated)"""


@query(f"WITH {_PERF} SELECT session_id, fishing_s, travel_s, unknown_s, n_segments, landed, round(CASE WHEN fishing_s > 0 THEN landed / h END, 6) AS cpue, round(0.5 + confidence * ((CASE WHEN h >= 0.25 THEN least(greatest(0.5 + 0.5 * tanh((p - 0.5) / 0.5), 0), 1) ELSE 0.5 END) - 0.5), 6) AS score, round(confidence, 6) AS confidence FROM posted")
def flagship_effort(spark, d):
    flagged = _flagged(spark, d)
    catches = flagged.filter("kind = 'purchase'").groupBy("session_id").agg(F.count("*").alias("landed"))
    found = E.session_performance(E.effort_segments(E.point_pairs(flagged.filter("quality = 'ACCEPTED'")), max_gap_s=GAP_S), catches)
    return found.select("session_id", "fishing_s", "travel_s", "unknown_s", "n_segments", "landed", *[F.round(c, 6).alias(c) for c in ("cpue", "score", "confidence")])


_PAUSES = """pauses AS (SELECT user_id AS session_id, epoch_us(ts) // 1000000 AS paused, CASE WHEN value < 150 THEN epoch_us(ts) // 1000000 + 3600 * CAST(json_extract_string(props, '$.k') AS BIGINT) END AS resumed FROM events WHERE event_type = 'error' AND value > 120)"""


@query(f"WITH {_PAIRS}, {_PAUSES} SELECT session_id, point_id FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pauses q WHERE q.session_id = p.session_id AND (p.start + p.\"end\") / 2 >= paused AND (resumed IS NULL OR (p.start + p.\"end\") / 2 < resumed))")
def join_pause_midpoint(spark, d):
    p = points(spark, d).filter("kind = 'error' AND value > 120").select("session_id", F.col("at").alias("paused"), F.when(F.col("value") < 150, F.col("at") + 3600 * F.col("k")).alias("resumed"))
    return E.without_paused(E.point_pairs(_flagged(spark, d).filter("quality = 'ACCEPTED'")), p).select("session_id", "point_id")


@query(f"""WITH {POINTS}, i AS (SELECT *, {mean_scale_sql('-78.95', '44.05', 'lon', 'lat')} <= 3000 AS inside FROM points),
r AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS run FROM i),
s AS (SELECT session_id, point_id, CAST(sum(inside :: INT) OVER w AS BIGINT) AS samples, CAST(coalesce(at - min(CASE WHEN inside THEN at END) OVER w, 0) AS BIGINT) AS span_s FROM r WINDOW w AS (PARTITION BY session_id, run ORDER BY at, point_id ROWS UNBOUNDED PRECEDING))
SELECT *, samples >= 2 AND span_s >= 30 AS arrived FROM s""")
def win_trailing_inside(spark, d):
    s = E.within_radius_suffix(points(spark, d), F.lit(-78.95), F.lit(44.05), 3000)
    return s.select("session_id", "point_id", "samples", "span_s", ((F.col("samples") >= 2) & (F.col("span_s") >= 30)).alias("arrived"))


@query(f"WITH {POINTS} SELECT session_id, kind, point_id, value FROM points QUALIFY row_number() OVER (PARTITION BY session_id, kind ORDER BY at DESC, point_id) = 1")
def win_latest_per_key(spark, d):
    return first_per_key(points(spark, d), ["session_id", "kind"], F.desc("at"), F.asc("point_id")).select("session_id", "kind", "point_id", "value")


@query(f"WITH {POINTS}, s AS (SELECT *, sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS island FROM points), c AS (SELECT session_id, point_id, row_number() OVER (PARTITION BY session_id, island ORDER BY at, point_id) AS streak FROM s WHERE kind = 'error') SELECT session_id, point_id, streak FROM c WHERE streak = 3")
def win_streak(spark, d):
    return T.streaks(points(spark, d), ["session_id"], ["at", "point_id"], F.col("kind") == "error", F.col("kind") == "purchase").filter("streak = 3").select("session_id", "point_id", "streak")


@query(f"WITH {POINTS}, j AS (SELECT *, k // 30 AS reason FROM points), m AS (SELECT *, CASE WHEN kind <> 'error' OR lag(kind) OVER w IS DISTINCT FROM kind OR lag(reason) OVER w IS DISTINCT FROM reason THEN 1 ELSE 0 END AS fresh FROM j WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT session_id, point_id, reason, row_number() OVER (PARTITION BY session_id, island ORDER BY at, point_id) AS streak FROM n WHERE kind = 'error'")
def win_reject_streak(spark, d):
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    rows = points(spark, d).withColumn("reason", F.floor(F.col("k") / 30))
    breaks = (F.col("kind") != "error") | ~F.lag("kind").over(w).eqNullSafe(F.col("kind")) | ~F.lag("reason").over(w).eqNullSafe(F.col("reason"))
    return T.streaks(rows, ["session_id"], ["at", "point_id"], F.col("kind") == "error", breaks).select("session_id", "point_id", "reason", "streak")


@query(f"WITH {POINTS} SELECT session_id, point_id, last_value(CASE WHEN kind = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS wind FROM points")
def win_last_non_null(spark, d):
    w = Window.partitionBy("session_id").orderBy("at", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    return points(spark, d).select("session_id", "point_id", F.last(F.when(F.col("kind") == "view", F.col("value")), ignorenulls=True).over(w).alias("wind"))


@query(f"WITH {POINTS} SELECT session_id, at // 86400 AS day, CASE WHEN count(DISTINCT kind) > 1 THEN 'VARIABLE' ELSE max(kind) END AS direction FROM points GROUP BY 1, 2")
def win_distinct_or_variable(spark, d):
    one = F.when(F.min("kind") != F.max("kind"), "VARIABLE").otherwise(F.max("kind"))
    return points(spark, d).groupBy("session_id", F.floor(F.col("at") / 86400).alias("day")).agg(one.alias("direction"))


@query(f"WITH {_PAIRS} SELECT session_id, point_id, round(sum(distance) OVER (PARTITION BY session_id ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING), 2) AS metres FROM pairs")
def win_cumulative_length(spark, d):
    w = Window.partitionBy("session_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return E.point_pairs(_flagged(spark, d).filter("quality = 'ACCEPTED'")).select("session_id", "point_id", F.round(F.sum("distance").over(w), 2).alias("metres"))


@query(f"WITH {POINTS}, i AS (SELECT *, {mean_scale_sql('-78.95', '44.05', 'lon', 'lat')} <= 5000 AS inside FROM points), l AS (SELECT session_id, inside AND lag(inside) OVER w AS stays, at - lag(at) OVER w AS dt FROM i WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)) SELECT session_id, CAST(sum(CASE WHEN stays THEN dt ELSE 0 END) AS BIGINT) AS dwell_s FROM l GROUP BY 1")
def win_dwell_accumulate(spark, d):
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    inside = E.mean_scale_distance(F.lit(-78.95), F.lit(44.05), "lon", "lat") <= 5000
    rows = points(spark, d).withColumn("inside", inside).select("session_id", (F.col("inside") & F.lag("inside").over(w)).alias("both"), (F.col("at") - F.lag("at").over(w)).alias("dt"))
    return rows.groupBy("session_id").agg(F.sum(F.when(F.col("both"), F.col("dt")).otherwise(0)).alias("dwell_s"))


@query(f"WITH {POINTS}, h AS (SELECT session_id, point_id, at AS s, at + 3600 * (k + 1) AS e FROM points), b AS (SELECT h.*, unnest(range(s // 86400, e // 86400 + 1)) AS day FROM h), c AS (SELECT session_id, point_id, greatest(s, day * 86400) AS ps, least(e, (day + 1) * 86400) AS pe FROM b) SELECT session_id, point_id, ps AS part_start, pe AS part_end FROM c WHERE pe > ps")
def win_bucket_split(spark, d):
    rows = points(spark, d).select("session_id", "point_id", F.col("at").alias("s"), (F.col("at") + 3600 * (F.col("k") + 1)).alias("e"))
    midnights = F.transform(F.sequence(F.floor(F.col("s") / 86400), F.floor(F.col("e") / 86400)), lambda day: day * 86400)
    return T.split_at(rows, "s", "e", midnights).select("session_id", "point_id", "part_start", "part_end")


@query(f"WITH {POINTS}, n AS (SELECT session_id, point_id, at, lead(at) OVER (PARTITION BY session_id, kind ORDER BY at, point_id) AS next_at FROM points) SELECT session_id, point_id, least(at + 86400, coalesce(next_at, at + 86400)) AS closes FROM n")
def win_lifecycle_invalidate(spark, d):
    rows = points(spark, d).select("session_id", F.col("point_id").alias("decision_id"), F.col("kind").alias("dimension"), "at", F.lit(True).alias("followed"), F.lit(86400).alias("length_s"))
    return A.decision_windows(rows, "length_s").select("session_id", F.col("decision_id").alias("point_id"), "closes")


# --- as-of and range joins

_SIDES = f"{POINTS}, l AS (SELECT * FROM points WHERE kind = 'purchase'), r AS (SELECT * FROM points WHERE kind = 'click'), v AS (SELECT * FROM points WHERE kind = 'view')"


def _kind(spark, d, kind):
    return points(spark, d).filter(F.col("kind") == kind)


@query(f"WITH {_SIDES} SELECT l.session_id, l.point_id, arg_max(r.value, r.at * 10000000 + r.point_id) AS lure_value FROM l LEFT JOIN r ON l.session_id = r.session_id AND r.at <= l.at GROUP BY 1, 2")
def join_asof_backward(spark, d):
    return T.as_of(_kind(spark, d, "purchase"), _kind(spark, d, "click"), ["session_id"], "at", "at", "point_id", ["value"], "lure_").select("session_id", "point_id", "lure_value")


@query(f"WITH {_SIDES} SELECT l.session_id, l.point_id, arg_max(v.value, v.at * 10000000 + v.point_id) AS wind_value, arg_max(v.k, v.at * 10000000 + v.point_id) AS wind_k FROM l LEFT JOIN v ON l.session_id = v.session_id AND v.at <= l.at GROUP BY 1, 2")
def join_asof_weather(spark, d):
    return T.as_of(_kind(spark, d, "purchase"), _kind(spark, d, "view"), ["session_id"], "at", "at", "point_id", ["value", "k"], "wind_").select("session_id", "point_id", "wind_value", "wind_k")


@query(f"WITH {_SIDES} SELECT l.session_id, l.point_id, coalesce(arg_max(v.point_id, v.at * 10000000 + v.point_id) FILTER (WHERE v.at <= l.at), arg_min(v.point_id, v.at * 10000000 + v.point_id) FILTER (WHERE v.at > l.at)) AS nearest FROM l LEFT JOIN v ON l.session_id = v.session_id GROUP BY 1, 2")
def join_asof_then_nearest(spark, d):
    left, right = _kind(spark, d, "purchase"), _kind(spark, d, "view").withColumn("view_id", F.col("point_id"))
    before = T.as_of(left, right, ["session_id"], "at", "at", "point_id", ["view_id"], "b_")
    # Nothing at or before: of what follows the nearest is the first, an as-of join with time reversed.
    back = T.as_of(before.withColumn("neg", -F.col("at")), right.withColumns({"neg": -F.col("at"), "neg_id": -F.col("point_id")}), ["session_id"], "neg", "neg", "neg_id", ["view_id"], "a_")
    return back.select("session_id", "point_id", F.coalesce("b_view_id", "a_view_id").alias("nearest"))


_SPANS = f"""{POINTS}, seg AS (SELECT session_id, point_id AS segment_id, at AS s, at + 600 * k + 1 AS e FROM points WHERE kind = 'view'), win AS (SELECT session_id, point_id AS window_id, at - 3600 AS s, at + 300 * k + 1 AS e FROM points WHERE kind = 'click')"""


def _spans(spark, d):
    p = points(spark, d)
    seg = p.filter("kind = 'view'").select("session_id", F.col("point_id").alias("segment_id"), F.col("at").alias("s"), (F.col("at") + 600 * F.col("k") + 1).alias("e"))
    win = p.filter("kind = 'click'").select("session_id", F.col("point_id").alias("window_id"), (F.col("at") - 3600).alias("ws"), (F.col("at") + 300 * F.col("k") + 1).alias("we"))
    return p, seg, win


@query(f"WITH {_SPANS} SELECT p.session_id, p.point_id, arg_min(segment_id, s * 10000000 + segment_id) AS segment_id FROM points p JOIN seg ON p.session_id = seg.session_id AND p.at >= s AND p.at < e GROUP BY 1, 2")
def join_interval_contains(spark, d):
    p, seg, _ = _spans(spark, d)
    return first_per_key(T.contained_in(p, seg, ["session_id"], "at", "s", "e", 21_600), ["session_id", "point_id"], F.asc("s"), F.asc("segment_id")).select("session_id", "point_id", "segment_id")


@query(f"WITH {_SPANS} SELECT seg.session_id, segment_id, window_id, greatest(seg.s, win.s) AS overlap_start, least(seg.e, win.e) AS overlap_end FROM seg JOIN win ON seg.session_id = win.session_id AND greatest(seg.s, win.s) < least(seg.e, win.e)")
def join_interval_overlap(spark, d):
    _, seg, win = _spans(spark, d)
    return T.overlaps(seg, win, ["session_id"], ("s", "e"), ("ws", "we"), 21_600).select("session_id", "segment_id", "window_id", "overlap_start", "overlap_end")


@query(f"WITH {_SPANS}, i AS (SELECT session_id, s, e FROM seg UNION ALL SELECT session_id, s, e FROM win), m AS (SELECT *, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m), u AS (SELECT session_id, island, max(e) - min(s) AS len FROM n GROUP BY 1, 2) SELECT session_id, CAST(sum(len) AS BIGINT) AS covered, count(*) AS n_islands FROM u GROUP BY 1")
def agg_interval_union(spark, d):
    _, seg, win = _spans(spark, d)
    return T.union_length(seg.select("session_id", "s", "e").unionByName(win.select("session_id", F.col("ws").alias("s"), F.col("we").alias("e"))), ["session_id"], "s", "e")


@query(f"""WITH {_SPANS}, inside AS (SELECT w.session_id, w.window_id, count(*) AS n, max(p.value) AS top FROM win w JOIN points p ON p.kind = 'view' AND p.session_id = w.session_id AND p.at >= w.s AND p.at < w.e GROUP BY 1, 2),
before AS (SELECT w.session_id, w.window_id, arg_max(p.value, p.at * 10000000 + p.point_id) AS last_value FROM win w JOIN points p ON p.kind = 'view' AND p.session_id = w.session_id AND p.at <= w.s GROUP BY 1, 2)
SELECT w.session_id, w.window_id, coalesce(n, 0) AS n, coalesce(top, last_value) AS wind FROM win w LEFT JOIN inside i ON i.window_id = w.window_id LEFT JOIN before b ON b.window_id = w.window_id""")
def join_range_weather_window(spark, d):
    p, _, win = _spans(spark, d)
    views = p.filter("kind = 'view'")
    inside = T.contained_in(views.select("session_id", "at", "value"), win, ["session_id"], "at", "ws", "we", 21_600).groupBy("window_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    before = T.as_of(win, views, ["session_id"], "ws", "at", "point_id", ["value"], "last_")
    return before.join(inside, "window_id", "left").select("session_id", "window_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", "last_value").alias("wind"))


@query(f"WITH {POINTS} SELECT session_id, point_id, count(*) FILTER (WHERE kind = 'click') OVER (PARTITION BY session_id ORDER BY at RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS bites FROM points")
def stm_sliding_count(spark, d):
    w = Window.partitionBy("session_id").orderBy("at").rangeBetween(-86400, 0)
    return points(spark, d).select("session_id", "point_id", F.count(F.when(F.col("kind") == "click", 1)).over(w).alias("bites"))


@query(f"WITH {POINTS} SELECT at // 3600 * 3600 AS window_start, kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM points GROUP BY 1, 2")
def stm_tumbling_rollup(spark, d):
    return points(spark, d).groupBy((F.floor(F.col("at") / 3600) * 3600).alias("window_start"), "kind").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# --- attribution and rates of followed guidance

_DIMENSION = "CASE k // 25 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'LURE' WHEN 2 THEN 'DEPTH' ELSE 'RETRIEVE' END"
_OUTCOME = "CASE kind WHEN 'signup' THEN 'NONE' WHEN 'view' THEN 'NO_BITE' WHEN 'click' THEN 'BITE' WHEN 'error' THEN 'FISH_ON' ELSE 'CATCH_LANDED' END"
_RANK = "CASE outcome WHEN 'NO_BITE' THEN 1 WHEN 'BITE' THEN 2 WHEN 'FISH_ON' THEN 3 WHEN 'CATCH_LANDED' THEN 4 ELSE 0 END"
_SUCCESS = "outcome IN ('FISH_ON', 'CATCH_LANDED', 'CATCH_LOST')"
_DECIDED = f"{POINTS}, decided AS (SELECT session_id, point_id AS decision_id, {_DIMENSION} AS dimension, value > 30 AS followed, at, 172800 AS length_s FROM points WHERE kind = 'view'), signals AS (SELECT session_id, point_id AS signal_id, CASE WHEN value > 15 THEN k END AS interaction_id, {_OUTCOME} AS kind, at FROM points WHERE kind IN ('click', 'error', 'purchase'))"


def _dimension():
    return F.element_at(F.array(*map(F.lit, ("LOCATION", "LURE", "DEPTH", "RETRIEVE"))), (F.least(F.floor(F.col("k") / 25), F.lit(3)) + 1).cast("int"))


def _outcome():
    kind = F.col("kind")
    return F.when(kind == "signup", "NONE").when(kind == "view", "NO_BITE").when(kind == "click", "BITE").when(kind == "error", "FISH_ON").otherwise("CATCH_LANDED")


@query(f"""WITH {_DECIDED}, windows AS (SELECT *, at AS opens, least(at + length_s, coalesce(min(CASE WHEN followed THEN at END) OVER (PARTITION BY session_id, dimension ORDER BY at, decision_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), at + length_s)) AS closes FROM decided),
met AS (SELECT w.*, s.interaction_id, s.kind AS outcome, s.at AS signal_at, s.signal_id FROM windows w JOIN signals s ON w.session_id = s.session_id AND s.at BETWEEN opens AND closes WHERE s.kind <> 'BITE' OR s.interaction_id IS NOT NULL),
best AS (SELECT *, (signal_at - opens) / length_s AS r FROM met QUALIFY row_number() OVER (PARTITION BY decision_id, dimension, interaction_id ORDER BY {_RANK} DESC, signal_at DESC, signal_id DESC) = 1)
SELECT session_id, decision_id, dimension, followed, interaction_id, outcome, round(CASE WHEN r <= 1 THEN 1 - 0.7 * r WHEN r <= 2 THEN 0.3 * (2 - r) ELSE 0 END, 9) AS confidence FROM best
UNION ALL SELECT session_id, decision_id, dimension, followed, NULL, 'NO_BITE', 1.0 FROM windows WHERE followed AND decision_id NOT IN (SELECT decision_id FROM best WHERE {_SUCCESS})""")
def alg_attribution(spark, d):
    p = points(spark, d)
    decided = p.filter("kind = 'view'").select("session_id", F.col("point_id").alias("decision_id"), _dimension().alias("dimension"), (F.col("value") > 30).alias("followed"), "at", F.lit(172_800).alias("length_s"))
    signals = p.filter("kind IN ('click', 'error', 'purchase')").select("session_id", F.col("point_id").alias("signal_id"), F.when(F.col("value") > 15, F.col("k")).alias("interaction_id"), _outcome().alias("kind"), "at")
    return A.attribute(A.decision_windows(decided, "length_s"), signals, "length_s", 21_600).withColumn("confidence", F.round("confidence", 9))


_OBSERVED = f"{POINTS}, observed AS (SELECT session_id, point_id AS id, session_id * 100 + k AS decision_id, {_DIMENSION} AS dimension, {_OUTCOME} AS outcome, value > 20 AS followed, value > 90 AS other, at, CASE WHEN value < 20 THEN 'REJECTED' WHEN value < 40 THEN 'PARTIALLY_FOLLOWED' WHEN value < 60 THEN 'ACKNOWLEDGED' ELSE 'ACCEPTED' END AS status FROM points)"


def _observed(spark, d):
    v = F.col("value")
    return points(spark, d).select(
        "session_id", F.col("point_id").alias("id"), (F.col("session_id") * 100 + F.col("k")).alias("decision_id"), _dimension().alias("dimension"), _outcome().alias("outcome"), (v > 20).alias("followed"), (v > 90).alias("other"), "at",
        F.when(v < 20, "REJECTED").when(v < 40, "PARTIALLY_FOLLOWED").when(v < 60, "ACKNOWLEDGED").otherwise("ACCEPTED").alias("status"),
    )


@query(f"WITH {_OBSERVED} SELECT decision_id, dimension, bool_or(followed) AS followed, arg_max(outcome, ({_RANK}) * 100000000000000000 + at * 10000000 + id) AS outcome FROM observed GROUP BY 1, 2")
def win_priority_merge(spark, d):
    return A.merged_outcomes(_observed(spark, d), ["decision_id", "dimension"])


_KINDS = f"CASE WHEN NOT followed THEN 'NOT_FOLLOWED' WHEN {_SUCCESS} THEN 'FISH_ON_SUCCESS' WHEN outcome = 'BITE' THEN 'BITE_SIGNAL_ONLY' ELSE 'NO_FISH_SIGNAL' END"
_MERGED = f"merged AS (SELECT decision_id, dimension, bool_or(followed) AS followed, arg_max(outcome, ({_RANK}) * 100000000000000000 + at * 10000000 + id) AS outcome FROM observed GROUP BY 1, 2)"


@query(f"WITH {_OBSERVED}, {_MERGED} SELECT dimension, {_KINDS} AS kind, count(*) AS n FROM merged GROUP BY 1, 2")
def agg_metric_kinds(spark, d):
    merged = A.merged_outcomes(_observed(spark, d), ["decision_id", "dimension"])
    return merged.groupBy("dimension", A.success_kind("decision_id", "followed", "outcome").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {_OBSERVED}, {_MERGED}, whole AS (SELECT decision_id, bool_or(followed) AS followed, arg_max(outcome, ({_RANK}) * 100000000000000000 + at * 10000000 + id) AS outcome FROM observed GROUP BY 1), every AS (SELECT dimension, followed, outcome FROM merged UNION ALL SELECT NULL, followed, outcome FROM whole) SELECT dimension, count(*) AS n, count(*) FILTER (WHERE followed) AS followed, count(*) FILTER (WHERE followed AND {_SUCCESS}) AS success, round(count(*) FILTER (WHERE followed AND {_SUCCESS}) / nullif(count(*) FILTER (WHERE followed), 0), 6) AS success_rate FROM every GROUP BY 1")
def agg_total_plus_dims(spark, d):
    rows = _observed(spark, d)
    # Not a rollup: one interaction counts once in the total, whatever its dimensions.
    by_dimension = A.merged_outcomes(rows, ["decision_id", "dimension"])
    whole = A.merged_outcomes(rows, ["decision_id"]).withColumn("dimension", F.lit(None).cast("string"))
    won = F.col("followed") & F.col("outcome").isin(*A.SUCCESS)
    sums = by_dimension.unionByName(whole).groupBy("dimension").agg(F.count("*").alias("n"), F.count_if("followed").alias("followed"), F.count_if(won).alias("success"))
    return sums.withColumn("success_rate", F.round(rate("success", "followed"), 6))


_LATEST = "latest AS (SELECT decision_id, status FROM observed QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY at DESC, id) = 1)"


@query(f"WITH {_OBSERVED}, {_LATEST} SELECT count(*) FILTER (WHERE status = 'ACCEPTED') AS accepted, count(*) FILTER (WHERE status = 'PARTIALLY_FOLLOWED') AS partial, count(*) FILTER (WHERE status = 'REJECTED') AS rejected, count(*) AS total FROM latest")
def agg_acceptance(spark, d):
    latest = first_per_key(_observed(spark, d), ["decision_id"], F.desc("at"), F.asc("id"))
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return latest.agg(n("ACCEPTED", "accepted"), n("PARTIALLY_FOLLOWED", "partial"), n("REJECTED", "rejected"), F.count("*").alias("total"))


@query(f"WITH {_OBSERVED}, keys AS (SELECT decision_id, dimension, bool_or(followed) AS f FROM (SELECT decision_id, dimension, followed FROM observed UNION ALL SELECT decision_id, dimension, true FROM observed WHERE followed AND {_SUCCESS}) GROUP BY 1, 2) SELECT count(*) FILTER (WHERE f) AS followed, count(*) AS eligible FROM keys")
def agg_follow_through(spark, d):
    rows = _observed(spark, d)
    from_outcomes = rows.filter(F.col("followed") & F.col("outcome").isin(*A.SUCCESS)).select("decision_id", "dimension", F.lit(True).alias("followed"))
    keys = rows.select("decision_id", "dimension", "followed").unionByName(from_outcomes).groupBy("decision_id", "dimension").agg(F.bool_or("followed").alias("f"))
    return keys.agg(F.count_if("f").alias("followed"), F.count("*").alias("eligible"))


@query(f"WITH {_OBSERVED}, feedback AS (SELECT decision_id, status FROM observed WHERE outcome <> 'BITE' QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY at DESC, id) = 1), acts AS (SELECT decision_id, bool_or(followed) AS f, bool_or(other) AS o FROM observed WHERE outcome <> 'NONE' GROUP BY 1), j AS (SELECT coalesce(status = 'ACCEPTED', false) AS a, coalesce(f, false) AS f, coalesce(o, false) AS o FROM feedback FULL JOIN acts ON feedback.decision_id = acts.decision_id) SELECT count(*) FILTER (WHERE (a AND NOT f) OR (NOT a AND o)) AS overrides, count(*) AS eligible FROM j")
def agg_override(spark, d):
    rows = _observed(spark, d)
    feedback = first_per_key(rows.filter("outcome <> 'BITE'"), ["decision_id"], F.desc("at"), F.asc("id")).select("decision_id", "status")
    return A.override_flags(feedback, rows.filter("outcome <> 'NONE'")).agg(F.count_if("overridden").alias("overrides"), F.count("*").alias("eligible"))


# --- the performance cube and its back-off

_CUBE = f"""{POINTS}, grains AS (SELECT session_id, kind AS zone, CASE WHEN month(make_timestamp(at * 1000000)) IN (12, 1, 2) THEN 'WINTER' ELSE 'SPRING' END AS season, CASE WHEN at // 3600 % 24 >= 20 THEN 'NIGHT' WHEN at // 3600 % 24 >= 17 THEN 'EVENING' WHEN at // 3600 % 24 >= 14 THEN 'AFTERNOON' WHEN at // 3600 % 24 >= 11 THEN 'MIDDAY' WHEN at // 3600 % 24 >= 7 THEN 'MORNING' WHEN at // 3600 % 24 >= 5 THEN 'DAWN' ELSE 'NIGHT' END AS time_bucket, CASE WHEN value < 10 THEN 'CALM' WHEN value < 25 THEN 'MODERATE' ELSE 'STRONG' END AS wind, 60 * k AS effort_s, (k % 3 = 0) :: BIGINT AS bites, (k % 9 = 0) :: BIGINT AS fish_on, (k % 27 = 0) :: BIGINT AS landed FROM points)"""


def _grains(spark, d):
    k = F.col("k")
    month = F.month(F.lit("1970-01-01").cast("date") + F.floor(F.col("at") / 86400).cast("int"))
    return points(spark, d).select("session_id", F.col("kind").alias("zone"), season(month).alias("season"), time_bucket(F.floor(F.col("at") / 3600) % 24).alias("time_bucket"), wind_bucket("value").alias("wind"), (60 * k).alias("effort_s"), *[(k % m == 0).cast("long").alias(n) for m, n in ((3, "bites"), (9, "fish_on"), (27, "landed"))])


_COUNTS = ("effort_s", "bites", "fish_on", "landed")
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTS)


@query(f"WITH {_CUBE}, c AS (SELECT zone, wind, {_SUMS} FROM grains GROUP BY 1, 2) SELECT zone, wind, round(bites / nullif(effort_s / 3600.0, 0), 6) AS bite_rate, round(fish_on / nullif(effort_s / 3600.0, 0), 6) AS fish_on_rate, round(landed / nullif(effort_s / 3600.0, 0), 6) AS cpue, round(landed / nullif(fish_on, 0), 6) AS landing_ratio FROM c")
def agg_derive_rates(spark, d):
    c = _grains(spark, d).groupBy("zone", "wind").agg(*[F.sum(x).alias(x) for x in _COUNTS])
    hours = F.col("effort_s") / 3600.0
    rates = {"bite_rate": rate("bites", hours), "fish_on_rate": rate("fish_on", hours), "cpue": rate("landed", hours), "landing_ratio": rate("landed", "fish_on")}
    return c.select("zone", "wind", *[F.round(e, 6).alias(n) for n, e in rates.items()])


_SCORED = "CASE WHEN h >= 0.25 THEN (n + 2.0) / (h + 4) ELSE 0.5 END"


@query(f"WITH {_CUBE}, c AS (SELECT session_id, zone, sum(fish_on) AS n, sum(effort_s) / 3600.0 AS h FROM grains GROUP BY 1, 2), p AS (SELECT *, {_SCORED} AS posterior, CASE WHEN h >= 0.25 THEN h / (h + 4) ELSE 0.0 END AS confidence FROM c), s AS (SELECT *, CASE WHEN h >= 0.25 THEN least(greatest(0.5 + 0.5 * tanh((posterior - 0.5) / 0.5), 0), 1) ELSE 0.5 END AS raw FROM p) SELECT session_id, zone, round(posterior, 6) AS posterior, round(raw, 6) AS raw_score, round(confidence, 6) AS confidence, round(0.5 + confidence * (raw - 0.5), 6) AS score FROM s")
def agg_shrinkage(spark, d):
    c = _grains(spark, d).groupBy("session_id", "zone").agg(F.sum("fish_on").alias("n"), (F.sum("effort_s") / 3600.0).alias("h"))
    return c.select("session_id", "zone", *[F.round(e, 6).alias(name) for name, e in shrinkage("n", "h").items()])


@query(f"WITH {_CUBE} SELECT session_id, CAST(sum(bites) AS BIGINT) AS bites, CAST(sum(fish_on) AS BIGINT) AS fish_on, CAST(sum(landed) AS BIGINT) AS landed, CAST(sum(effort_s) AS BIGINT) AS effort_s, count(*) AS events FROM grains GROUP BY 1")
def alg_session_summary(spark, d):
    return _grains(spark, d).groupBy("session_id").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.count("*").alias("events"))
