"""Queries that run a stream over the given events to its end, with the SQL of the same rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators.lineage import checkpoint_folder
from driftline.plans.base import POINTS, mean_scale_sql, points, query
from driftline.streaming import stateful, timers


#: State of a key that has had no row for so long is dropped.
YEAR_S = 365 * 86_400


def _run(spark, rows, transform):
    """The result of a stream of ``rows`` after ``transform``."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return stateful.drained(transform(stateful.replayed(rows, f"{folder}/in")), folder)


@query(f"WITH {POINTS} SELECT session_id, k AS client_id, count(*) > 0 AS kept FROM points GROUP BY 1, 2")
def stm_dedup(spark, d):
    """Repeated client ids of a session go."""
    p = points(spark, d).select("session_id", F.col("k").alias("client_id"), F.timestamp_seconds("at").alias("ts"))
    kept = _run(spark, p, lambda stream: stateful.deduplicated(stream, ["session_id", "client_id"], "ts", "60 days"))
    return kept.select("session_id", "client_id", F.lit(True).alias("kept"))


@query(f"WITH RECURSIVE {POINTS}, ranked AS (SELECT session_id, kind, at, row_number() OVER (PARTITION BY session_id, kind ORDER BY at, point_id) AS i FROM points), walk AS (SELECT session_id, kind, i, at, at AS last, true AS fires FROM ranked WHERE i = 1 UNION ALL SELECT r.session_id, r.kind, r.i, r.at, CASE WHEN r.at - w.last >= 86400 THEN r.at ELSE w.last END, r.at - w.last >= 86400 FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.kind = w.kind AND r.i = w.i + 1) SELECT session_id, kind AS trigger, at FROM walk WHERE fires")
def stm_cooldown(spark, d):
    """Triggers of which none follows an emitted one of its kind within a day."""
    return _run(spark, points(spark, d).select("session_id", F.col("kind").alias("trigger"), "at"), lambda stream: stateful.with_cooldown(stream, 86_400, YEAR_S))


_M = mean_scale_sql("lon", "lat", "-78.95", "44.05")


@query(f"""WITH RECURSIVE {POINTS}, ranked AS (SELECT session_id, at, {_M} AS m, k > 97 AS skipped, row_number() OVER (PARTITION BY session_id ORDER BY at, {_M}) AS i FROM points),
walk AS (SELECT session_id, 0 :: BIGINT AS i, 'UPCOMING' AS state, 0 :: BIGINT AS inside, 0 :: BIGINT AS first, 0 :: BIGINT AS at, [] :: VARCHAR[] AS entered FROM (SELECT DISTINCT session_id FROM ranked)
UNION ALL SELECT session_id, i, CASE WHEN len(entered) > 0 THEN entered[-1] ELSE state END, inside, first, at, entered FROM (SELECT session_id, i, state, inside, first, at, CASE WHEN skipped AND state NOT IN ('COMPLETED', 'SKIPPED') THEN ['SKIPPED'] WHEN state IN ('UPCOMING', 'NAVIGATING') AND inside >= 2 AND at - first >= 30 THEN ['ARRIVED', 'FISHING'] WHEN state = 'UPCOMING' AND m <= 5000 THEN ['NAVIGATING'] WHEN state = 'FISHING' AND m > 4000 THEN ['COMPLETED'] ELSE [] END AS entered
  FROM (SELECT w.session_id, r.i, w.state, CASE WHEN m <= 3000 THEN w.inside + 1 ELSE 0 END AS inside, CASE WHEN m <= 3000 AND w.inside > 0 THEN w.first ELSE r.at END AS first, r.at, m, skipped FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.i = w.i + 1)))
SELECT session_id, at, unnest(entered) AS state FROM walk""")
def stm_waypoint_fsm(spark, d):
    """States that a session enters at one waypoint; limits are wider here, for positions lie far apart."""
    metres = geo.mean_scale_distance("lon", "lat", F.lit(-78.95), F.lit(44.05))
    rows = points(spark, d).select("session_id", F.lit(1).cast("long").alias("waypoint_id"), "at", metres.alias("metres"), (F.col("k") > 97).alias("skipped"))
    found = _run(spark, rows, lambda stream: stateful.waypoint_states(stream, YEAR_S, radii=(5000.0, 3000.0, 4000.0), samples=2))
    return found.select("session_id", "at", "state")


#: Seconds after which an active session is quiet, and between heartbeats.
QUIET_S, BEAT_S = 86_400, 21_600
_SAYS_SQL = f"""{POINTS}, said AS (SELECT session_id, point_id, at, CASE kind WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'RESET' WHEN 'view' THEN 'STOP' ELSE 'NONE' END AS says FROM points),
horizon AS (SELECT max(at) AS until FROM points)"""


def _in_batches(spark, rows, transform):
    """The result of a stream of ``rows`` in four micro-batches by time, with timers."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    with timers.timers_allowed(spark):
        return stateful.drained(transform(stateful.replayed_in_order(rows, f"{folder}/in", "at", 4)), folder)


def _said(spark, d):
    kind = F.col("kind")
    says = F.when(kind == "signup", timers.START).when(kind == "purchase", timers.RESET).when(kind == "view", timers.STOP).otherwise("NONE")
    return points(spark, d).select("session_id", "at", F.col("point_id").alias("place"), says.alias("says"))


@query(f"""WITH {_SAYS_SQL}, told AS (SELECT *, last_value(CASE WHEN says IN ('START', 'STOP') THEN says END IGNORE NULLS) OVER w AS phase, lead(at) OVER w AS next_at FROM said WHERE says <> 'NONE' WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id))
SELECT session_id, at AS since, at + {QUIET_S} AS at FROM told, horizon WHERE phase = 'START' AND coalesce(next_at >= at + {QUIET_S}, at + {QUIET_S} <= until)""")
def stm_no_bite_timer(spark, d):
    """Alarms of active sessions that nothing has reset for a day, by timers of a stream."""
    return _in_batches(spark, _said(spark, d), lambda stream: timers.quiet_alarms(stream, QUIET_S))


@query(f"""WITH {_SAYS_SQL}, told AS (SELECT *, lead(at) OVER (PARTITION BY session_id ORDER BY at, point_id) AS next_at FROM said WHERE says IN ('START', 'STOP')),
beats AS (SELECT session_id, at AS since, unnest(range(at + {BEAT_S}, coalesce(next_at, until) + 1, {BEAT_S})) AS at FROM told, horizon WHERE says = 'START') SELECT * FROM beats""")
def stm_heartbeat(spark, d):
    """Beats of active sessions, six hours apart here, by timers of a stream."""
    return _in_batches(spark, _said(spark, d), lambda stream: timers.heartbeats(stream, BEAT_S))


#: Seconds that a trigger stays open, and how triggers rank; users' own requests have no rank.
HOLD_S, RANKS = 43_200, {"purchase": 0, "signup": 1, "click": 2, "view": 3}
_RANK_SQL = " ".join(f"WHEN '{k}' THEN {r}" for k, r in RANKS.items())


@query(f"""WITH RECURSIVE {POINTS}, ranked AS (SELECT *, CASE kind {_RANK_SQL} END AS rank, row_number() OVER (PARTITION BY session_id ORDER BY at, point_id) AS i FROM points WHERE kind <> 'error'),
walk AS (SELECT session_id, i, at AS opened FROM ranked WHERE i = 1
  UNION ALL SELECT r.session_id, r.i, CASE WHEN r.at >= opened + {HOLD_S} THEN r.at ELSE opened END FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.i = w.i + 1),
met AS (SELECT session_id, opened, kind, min(i) AS first, min(rank) AS rank, count(*) AS n, bool_or(value > 50) AS from_event FROM walk JOIN ranked USING (session_id, i) GROUP BY session_id, opened, kind)
SELECT session_id, opened, arg_min(kind, rank) AS trigger, string_agg(kind, ',' ORDER BY first) AS reasons, CAST(sum(n) AS BIGINT) AS n, CASE WHEN bool_or(from_event) THEN 'EVENT' ELSE 'HEARTBEAT' END AS source
FROM met WHERE opened + {HOLD_S} <= (SELECT max(at) FROM points WHERE kind <> 'error') GROUP BY session_id, opened""")
def stm_coalesce_stream(spark, d):
    """Triggers that come while one is open join it, in the state of a stream; it is handed on half a day after it opened."""
    rows = points(spark, d).select("session_id", "at", F.col("point_id").alias("place"), F.col("kind").alias("trigger"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("from_event"))
    return _in_batches(spark, rows, lambda stream: timers.coalesced(stream, HOLD_S, RANKS))


def _for_each(spark, rows, order, write, folder):
    """Run ``write`` on the rows in four micro-batches by ``order``."""
    stream = stateful.replayed_in_order(rows, f"{folder}/in", order, 4)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


@query(f"WITH {POINTS} SELECT session_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM points GROUP BY 1")
def stm_late_data_stream(spark, d):
    """Catches that come late, after all else, have their sessions computed again from all rows, batch by batch."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    late = (F.col("kind") == "purchase") & (F.col("k") > 90)
    p = points(spark, d).select("session_id", "k", (F.col("at") + F.when(late, 10**9).otherwise(0)).alias("comes"))
    write = timers.recomputed(f"{folder}/results", f"{folder}/rows", ["session_id"], lambda rows: rows.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("k").alias("total")))
    _for_each(spark, p, "comes", write, folder)
    return timers.latest_results(spark, f"{folder}/results", ["session_id"]).select("session_id", "n", "total")


@query(f"WITH {POINTS} SELECT session_id, at, point_id, lon, lat FROM points QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at DESC, point_id DESC) = 1")
def stm_live_projection_stream(spark, d):
    """The latest position of each session, kept up to date by a stream."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    p = points(spark, d).select("session_id", "at", "point_id", "lon", "lat").withColumn("latest", F.struct("at", "point_id"))
    _for_each(spark, p, "at", stateful.upsert_latest(f"{folder}/live", ["session_id"], "latest"), folder)
    versions = spark.read.parquet(f"{folder}/live")
    return versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0]).select("session_id", "at", "point_id", "lon", "lat")


@query(f"""WITH {POINTS}, w AS (SELECT unnest([3600, 86400]) AS seconds), horizon AS (SELECT max(at) AS until FROM points)
SELECT seconds, at // seconds * seconds AS window_start, kind, count(*) AS n FROM points, w, horizon WHERE at // seconds * seconds + seconds <= until GROUP BY 1, 2, 3""")
def stm_tumbling_stream(spark, d):
    """Events by hour and by day, counted by streams; a window comes once the watermark has passed its end."""
    p = points(spark, d).select("at", "kind", F.timestamp_seconds("at").alias("ts"))
    found = []
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = stateful.replayed_in_order(p, f"{folder}/in", "at", 4)  # once for both
    for seconds, width in ((3600, "1 hour"), (86_400, "1 day")):
        with timers.timers_allowed(spark):
            counted = stateful.drained(stateful.tumbling_counts(stream, "ts", ["kind"], width, "0 seconds"), f"{folder}/{seconds}")
        found.append(counted.select(F.lit(seconds).alias("seconds"), F.unix_timestamp("window_start").alias("window_start"), "kind", "n"))
    return found[0].unionByName(found[1])
