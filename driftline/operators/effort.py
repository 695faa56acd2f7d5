"""Positions to quality flags, pairs, effort segments and session performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import mean_scale_distance
from driftline.functions.scores import shrinkage
from driftline.operators.relational import first_per_key
from driftline.operators.temporal import as_of, contained_in, islands

# Accuracy in metres, jump in metres at one time, and metres per second beyond which a point is poor.
MAX_ACCURACY_M, MAX_JUMP_M, MAX_SPEED_MPS = 50.0, 1.0, 40.0


def _by_session(*order: str):
    return Window.partitionBy("session_id").orderBy(*(order or ("at", "point_id")))


def quality_flags(points: DataFrame, accuracy: str, max_accuracy: float = MAX_ACCURACY_M) -> DataFrame:
    """``quality`` of each point against the one before it, whatever that one's quality."""
    w = _by_session()
    moved = mean_scale_distance(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat")
    rows = points.withColumns({"_dt": F.abs(F.col("at") - F.lag("at").over(w)), "_moved": moved})
    poor = (F.col(accuracy) > max_accuracy) | ((F.col("_dt") == 0) & (F.col("_moved") > MAX_JUMP_M)) | (F.try_divide("_moved", F.col("_dt")) > MAX_SPEED_MPS)
    return rows.withColumn("quality", F.when(poor, "LOW_QUALITY").otherwise("ACCEPTED")).drop("_dt", "_moved")


def point_pairs(points: DataFrame) -> DataFrame:
    """(session_id, point_id, start, end, dt, distance, speed) of consecutive points some time apart."""
    w = _by_session()
    pairs = points.select("session_id", "point_id", F.lag("at").over(w).alias("start"), F.col("at").alias("end"), mean_scale_distance(F.lag("lon").over(w), F.lag("lat").over(w), "lon", "lat").alias("distance"))
    return pairs.filter(F.col("end") > F.col("start")).withColumn("dt", F.col("end") - F.col("start")).withColumn("speed", F.col("distance") / F.col("dt"))


def without_paused(pairs: DataFrame, pauses: DataFrame) -> DataFrame:
    """Pairs whose midpoint is in no pause [paused, resumed) of the session; a null end is open.

    A midpoint is paused if the pauses that begin at or before it reach beyond
    it, which is one as-of join, whatever the number of pauses.
    """
    order = Window.partitionBy("session_id").orderBy("paused", F.asc_nulls_last("resumed"))
    reach = F.max(F.coalesce("resumed", F.lit(2**62))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    reached = pauses.select("session_id", F.col("paused").cast("double").alias("_paused"), reach.alias("reach"), F.row_number().over(order).alias("_o"))
    mid = pairs.withColumn("_mid", (F.col("start") + F.col("end")) / F.lit(2.0))
    found = as_of(mid, reached, ["session_id"], "_mid", "_paused", "_o", ["reach"], "_pause_")
    return found.filter(F.col("_pause_reach").isNull() | (F.col("_pause_reach") <= F.col("_mid"))).drop("_mid", "_pause_reach")


def effort_segments(pairs: DataFrame, max_gap_s: float = 120, slow_mps: float = 0.4) -> DataFrame:
    """Pairs typed by gap and speed, touching pairs of a type merged into one segment."""
    kind = F.when(F.col("dt") > max_gap_s, "UNKNOWN").when(F.col("speed") <= slow_mps, "FISHING").otherwise("TRAVEL")
    confidence = F.when(F.col("kind") == "UNKNOWN", 0.4).when(F.col("kind") == "FISHING", 1.0).otherwise(0.8)
    typed = pairs.withColumn("kind", kind).withColumn("confidence", confidence)
    w = _by_session("start", "end")
    breaks = ~F.lag("kind").over(w).eqNullSafe(F.col("kind")) | (F.lag("end").over(w) != F.col("start"))
    merged = islands(typed, ["session_id"], ["start", "end"], breaks)
    return merged.groupBy("session_id", "island", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("dt").alias("seconds"), F.max("confidence").alias("confidence"))


#: Metres around a waypoint that count as fishing it, and metres a second above which trolling is travel.
FISHING_RADIUS_M, MAX_TROLLING_MPS = 100.0, 2.5


def waypoint_visits(progress: DataFrame) -> DataFrame:
    """``left_at`` of each row of ``progress``: departed, else completed, else skipped."""
    return progress.withColumn("left_at", F.coalesce("departed", "completed", "skipped"))


def navigating_spans(progress: DataFrame, ended: str) -> DataFrame:
    """(session_id, n_start, n_end) in which a waypoint is under way: approached, or the first one from the session's start, and neither fished nor over."""
    p = waypoint_visits(progress)
    start = F.when(F.col("sequence") == 1, F.col("began")).otherwise(F.col("approached"))
    over = F.least(F.coalesce("skipped", F.col(ended) + 1), F.coalesce("completed", F.col(ended) + 1))
    # Before the arrival, and after a departure that has not completed the waypoint.
    spans = F.array(F.struct(start.alias("s"), F.least(over, F.coalesce("arrived", over)).alias("e")), F.struct(F.greatest(start, F.when(F.col("arrived").isNotNull(), F.col("left_at"))).alias("s"), F.when(F.col("arrived").isNotNull() & F.col("left_at").isNotNull(), over).alias("e")))
    return p.select("session_id", F.explode(spans).alias("n")).select("session_id", F.col("n.s").alias("n_start"), F.col("n.e").alias("n_end")).filter("n_start < n_end")


def typed_effort(pairs: DataFrame, stops: DataFrame, progress: DataFrame, max_gap_s: float = 120, radius_m: float = FISHING_RADIUS_M, max_trolling_mps: float = MAX_TROLLING_MPS, width: int = 3600) -> DataFrame:
    """``kind``, ``waypoint_id``, ``stop_id`` and ``confidence`` of each pair, by the first rule that holds at its end.

    A gap is UNKNOWN (0.4); an ad-hoc stop that covers it is FISHING (1.0); an
    arrived waypoint near enough, unless trolled too fast, is FISHING (1.0);
    under way, or near no arrived waypoint, is TRAVEL (0.8); else UNKNOWN (0.5).
    ``pairs``: (session_id, point_id, start, end, dt, speed, lon, lat); ``stops``:
    (session_id, stop_id, started, stopped); ``progress``: (session_id,
    waypoint_id, sequence, arrived, departed, completed, skipped, approached,
    w_lon, w_lat, trolling, began, ended), the last two being the session's.
    """
    keys, pair = ["session_id"], ["session_id", "point_id"]
    ends = pairs.select(*pair, F.col("end").alias("t"), "lon", "lat", "speed")
    covered = contained_in(ends.select(*pair, "t"), stops, keys, "t", "started", "stopped", width).groupBy(*pair).agg(F.min_by("stop_id", F.struct("started", "stop_id")).alias("stop_id"))
    visits = waypoint_visits(progress).filter("arrived IS NOT NULL").withColumn("until", F.coalesce("left_at", F.col("ended") + 1))
    near = contained_in(ends, visits, keys, "t", "arrived", "until", width).filter(mean_scale_distance("lon", "lat", "w_lon", "w_lat") <= radius_m)
    slow = ~(F.col("trolling") & (F.col("speed") > max_trolling_mps))
    fished = near.groupBy(*pair).agg(F.min_by("waypoint_id", F.when(slow, F.struct("sequence", "waypoint_id"))).alias("waypoint_id"), F.lit(True).alias("near"))
    under_way = contained_in(ends.select(*pair, "t"), navigating_spans(progress, "ended"), keys, "t", "n_start", "n_end", width).select(*pair).distinct().withColumn("under_way", F.lit(True))
    rows = pairs.join(covered, pair, "left").join(fished, pair, "left").join(under_way, pair, "left")
    gap, stop, waypoint = F.col("dt") > max_gap_s, F.col("stop_id").isNotNull(), F.col("waypoint_id").isNotNull()
    travel = F.col("under_way").isNotNull() | F.col("near").isNull()
    kind = F.when(gap, "UNKNOWN").when(stop | waypoint, "FISHING").when(travel, "TRAVEL").otherwise("UNKNOWN")
    confidence = F.when(gap, 0.4).when(stop | waypoint, 1.0).when(travel, 0.8).otherwise(0.5)
    return rows.select("session_id", "start", "end", kind.alias("kind"), F.when(~gap & ~stop, F.col("waypoint_id")).alias("waypoint_id"), F.when(~gap, F.col("stop_id")).alias("stop_id"), confidence.alias("confidence"))


def without_positions(spans: DataFrame, points: DataFrame, start: str, end: str, width: int = 3600) -> DataFrame:
    """Spans [start, end] of a session in which it has no point."""
    keyed = spans.withColumn("_until", F.col(end) + 1)
    met = contained_in(points.select("session_id", "at"), keyed.select("session_id", "span_id", start, "_until"), ["session_id"], "at", start, "_until", width)
    return spans.join(met.select("session_id", "span_id").distinct(), ["session_id", "span_id"], "left_anti")


def whole_effort(pairs: DataFrame, points: DataFrame, pauses: DataFrame, stops: DataFrame, progress: DataFrame, **limits) -> DataFrame:
    """Effort segments with all their branches: typed pairs, and stops and visits of which there is no position.

    The latter are FISHING with confidence 1.0 and 0.6. Pairs and spans whose
    midpoint is paused go. Neighbours of equal kind and waypoint that touch
    become one, with the greatest confidence and the first stop.
    """
    width = limits.get("width", 3600)
    typed = typed_effort(without_paused(pairs, pauses), stops, progress, **limits)
    visits = waypoint_visits(progress).select("session_id", F.col("waypoint_id").alias("span_id"), F.col("arrived").alias("start"), F.coalesce("left_at", "ended").alias("end"))
    at_stops = stops.select("session_id", F.col("stop_id").alias("span_id"), F.col("started").alias("start"), F.col("stopped").alias("end"))
    alone = lambda spans: without_paused(without_positions(spans.filter(F.col("end") > F.col("start")), points, "start", "end", width), pauses)
    null = F.lit(None).cast("long")
    drafts = typed.unionByName(alone(visits).select("session_id", "start", "end", F.lit("FISHING").alias("kind"), F.col("span_id").alias("waypoint_id"), null.alias("stop_id"), F.lit(0.6).alias("confidence")))
    drafts = drafts.unionByName(alone(at_stops).select("session_id", "start", "end", F.lit("FISHING").alias("kind"), null.alias("waypoint_id"), F.col("span_id").alias("stop_id"), F.lit(1.0).alias("confidence")))
    order = ["start", "end", "kind", "waypoint_id", "stop_id"]
    w = Window.partitionBy("session_id").orderBy(*order)
    breaks = ~(F.lag("kind").over(w).eqNullSafe(F.col("kind")) & F.lag("waypoint_id").over(w).eqNullSafe(F.col("waypoint_id")) & F.lag("end").over(w).eqNullSafe(F.col("start")))
    merged = islands(drafts, ["session_id"], order, breaks)
    first = F.struct(*order)
    return merged.groupBy("session_id", "island", "kind", "waypoint_id").agg(F.min("start").alias("start"), F.max_by("end", first).alias("end"), F.min_by("stop_id", first).alias("stop_id"), F.max("confidence").alias("confidence"))


# How a waypoint's status ranks when a catch near it is placed.
STATUS_RANK = {"NAVIGATING": 0, "ARRIVED": 0, "FISHING": 0, "UPCOMING": 1, "COMPLETED": 2, "SKIPPED": 2}


def associated_catches(catches: DataFrame, stops: DataFrame, progress: DataFrame, targets: DataFrame, radius_m: float = 60.0, width: int = 3600) -> DataFrame:
    """``method`` and place of each catch: what was said, a stop, the advised target, the current waypoint, then the nearest.

    ``catches``: (session_id, catch_id, at, lon, lat, said); said is a waypoint
    or null. ``progress`` as in ``typed_effort``, with ``status``; ``targets``: (session_id, target_id). A waypoint that was said
    counts if the session and its own progress allow the time.
    """
    c = ["session_id", "catch_id"]
    p = progress.withColumn("rank", F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_RANK.items() for x in pair]), F.col("status")))
    said = catches.join(p, "session_id").filter((F.col("said") == F.col("waypoint_id")) & (F.col("at") >= F.col("began")) & (F.col("at") <= F.col("ended")) & (F.col("skipped").isNull() | (F.col("at") < F.col("skipped"))) & (F.col("completed").isNull() | (F.col("at") < F.col("completed"))))
    metres = mean_scale_distance("lon", "lat", "w_lon", "w_lat")
    found = said.select(*c, F.lit(1).alias("step"), F.lit(0).alias("rank"), metres.alias("metres"), "sequence", F.lit("CURRENT_WAYPOINT").alias("method"), F.col("waypoint_id").alias("place"))
    held = contained_in(catches.filter("said IS NULL").select(*c, "at"), stops, ["session_id"], "at", "started", "stopped", width)
    found = found.unionByName(held.select(*c, F.lit(2).alias("step"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("metres"), F.col("started").cast("int").alias("sequence"), F.lit("AD_HOC_STOP").alias("method"), F.col("stop_id").alias("place")))
    first_active = p.filter(F.col("rank") == 0).groupBy("session_id").agg(F.min_by("waypoint_id", F.struct("sequence", "waypoint_id")).alias("active_id"))
    near = catches.filter("lon IS NOT NULL").join(p, "session_id").withColumn("metres", metres).filter(F.col("metres") <= radius_m).join(targets, "session_id", "left").join(first_active, "session_id", "left")
    step = F.when((F.col("waypoint_id") == F.col("target_id")) & (F.col("rank") < 2), 3).when(F.col("waypoint_id") == F.col("active_id"), 4).otherwise(5)
    found = found.unionByName(near.select(*c, step.alias("step"), "rank", "metres", "sequence", F.lit("NEAREST_WAYPOINT").alias("method"), F.col("waypoint_id").alias("place")))
    best = first_per_key(found, c, F.asc("step"), F.asc("rank"), F.asc("metres"), F.asc("sequence"), F.asc("place"))
    return catches.select(*c).join(best.select(*c, "method", "place"), c, "left").withColumn("method", F.coalesce("method", F.lit("UNASSOCIATED")))


def session_performance(segments: DataFrame, catches: DataFrame) -> DataFrame:
    """Seconds by type, landed count and shrunk score of each session; ``catches``: (session_id, landed)."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("seconds")).otherwise(0))
    effort = segments.groupBy("session_id").agg(of("FISHING").alias("fishing_s"), of("TRAVEL").alias("travel_s"), of("UNKNOWN").alias("unknown_s"), F.count("*").alias("n_segments"))
    both = effort.join(catches, "session_id", "left").withColumn("landed", F.coalesce("landed", F.lit(0)))
    score = shrinkage("landed", F.col("fishing_s") / 3600.0)
    return both.withColumns({"cpue": F.when(F.col("fishing_s") > 0, F.col("landed") / (F.col("fishing_s") / 3600.0)), "score": score["score"], "confidence": score["confidence"]})


def within_radius_suffix(points: DataFrame, lon: Column, lat: Column, radius_m: float) -> DataFrame:
    """``samples`` and ``span_s``: length of the run of points inside the radius that ends at each point."""
    inside = mean_scale_distance(lon, lat, "lon", "lat") <= radius_m
    runs = islands(points.withColumn("inside", inside), ["session_id"], ["at", "point_id"], ~F.col("inside"))
    w = Window.partitionBy("session_id", "island").orderBy("at", "point_id").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("inside"), F.col("at"))).over(w)
    return runs.withColumns({"samples": F.sum(F.col("inside").cast("long")).over(w), "span_s": F.coalesce(F.col("at") - first, F.lit(0))}).drop("island")
