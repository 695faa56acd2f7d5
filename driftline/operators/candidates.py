"""Choosing among candidates: greedy choices, matches, shortlists and resolved identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import METRES_PER_DEGREE, axis_distance
from driftline.operators.graph import greedy_independent
from driftline.operators.lineage import checkpointed as _checkpointed
from driftline.operators.relational import first_per_key, round_robin
from driftline.operators.temporal import as_of


#: Tasks among which the targets of one kind are dealt.
DEALT = 16


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Pairs (left, right, quality) that a walk by falling quality takes, each side at most once; ties by left, then right.

    A pair that is the best of both its ends is taken in any such walk; rounds
    of those, without the ends that are used up, give the walk's result.
    """
    left = _checkpointed(pairs.select("left", "right", "quality"))
    taken = None
    order = F.struct(F.col("quality"), -F.col("left"), -F.col("right"))
    while not left.isEmpty():
        best = lambda side: left.groupBy(side).agg(F.max(order).alias(f"best_{side}"))  # noqa: B023, E731
        both = left.join(best("left"), "left").join(best("right"), "right").filter((order == F.col("best_left")) & (order == F.col("best_right")))
        now = _checkpointed(both.select("left", "right", "quality"))
        taken = now if taken is None else taken.unionByName(now)
        left = _checkpointed(left.join(now.select("left"), "left", "left_anti").join(now.select("right"), "right", "left_anti").select("left", "right", "quality"))
    return pairs.select("left", "right", "quality").limit(0) if taken is None else taken


def resolved_identity(candidates: DataFrame, key: str, max_km: float = 15.0, close_km: float = 0.05) -> DataFrame:
    """One feature for each key, or why there is none: a feature that contains it goes before one of its name that is near.

    ``candidates``: key, feature_id, distance_km, contains, name_match,
    lake_type. Two nearest at about one distance are ambiguous.
    """
    fit = candidates.filter(F.col("contains") | (F.col("name_match") & (F.col("distance_km") <= max_km) & F.col("lake_type")))
    w = Window.partitionBy(key).orderBy(F.desc("contains"), "distance_km", "feature_id")
    first = fit.withColumns({"place": F.row_number().over(w), "next_km": F.lead("distance_km").over(w), "next_contains": F.lead("contains").over(w)}).filter("place = 1")
    tie = (F.col("next_contains") == F.col("contains")) & (F.abs(F.col("next_km") - F.col("distance_km")) < close_km)
    found = first.select(key, F.when(~F.coalesce(tie, F.lit(False)), F.col("feature_id")).alias("feature_id"), F.when(F.coalesce(tie, F.lit(False)), "AMBIGUOUS").when(F.col("contains"), "CONTAINS").otherwise("NAME").alias("method"))
    return candidates.select(key).distinct().join(found, key, "left").withColumn("method", F.coalesce("method", F.lit("UNRESOLVED")))


def selected_for_windows(targets: DataFrame, windows: DataFrame, keys: list[str], tolerance: float, wide_tolerance: float) -> DataFrame:
    """Targets of each window by type and depth, with the wide tolerance only where the window would be empty.

    ``targets``: keys, target_id, type, depth (null passes); ``windows``: keys,
    window_id, type, low, high (null is open): a row for each type wanted.
    Which windows would be empty is known before windows and targets meet, so
    their pairs are not moved.
    """
    near = min(tolerance, wide_tolerance)
    kinds = [*keys, "type"]
    # The shallowest depth that is not too shallow tells whether a window has a target: as-of, on depths turned round.
    depths = targets.filter("depth IS NOT NULL").select(*kinds, (-F.col("depth")).alias("t")).distinct().withColumn("depth", -F.col("t"))
    of_kind = targets.groupBy(*kinds).agg(F.bool_or(F.col("depth").isNull()).alias("any_depth"))
    asked = as_of(windows.withColumn("at", near - F.col("low")), depths, kinds, "at", "t", "t", ["depth"], "next_").join(of_kind, kinds)
    fits = F.col("low").isNull() | F.col("any_depth") | F.coalesce(F.col("next_depth") <= F.col("high") + near, F.lit(False))
    narrowed = asked.groupBy(*keys, "window_id").agg(F.bool_or(fits).alias("any_narrow"))
    reach = F.when(F.col("any_narrow"), near).otherwise(wide_tolerance)
    known = windows.join(narrowed, [*keys, "window_id"]).select(*kinds, "window_id", "any_narrow", (F.col("low") - reach).alias("low"), (F.col("high") + reach).alias("high"))
    # Few kinds have most of the pairs, so each kind's targets are dealt over tasks and its windows go to all of them.
    dealt = targets.withColumn("_deal", F.pmod(F.xxhash64("target_id"), F.lit(DEALT))).repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *kinds, "_deal")
    asking = known.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long")))).hint("merge")
    met = dealt.join(asking, [*kinds, "_deal"]).filter(F.col("depth").isNull() | F.col("low").isNull() | F.col("depth").between(F.col("low"), F.col("high")))
    return met.select(*keys, "window_id", "target_id", (~F.col("any_narrow")).alias("fallback"))


def macro_shortlist(members: DataFrame, min_members: int, per_type: int, max_zones: int) -> DataFrame:
    """Zones with enough members, scored by their best members of each type, taken in turns over the regions.

    ``members``: (region, zone_id, target_id, type, score); a null score means
    that the target is not within reach.
    """
    w = Window.partitionBy("zone_id", "type").orderBy(F.desc("score"), "target_id")
    ranked = members.withColumn("place", F.when(F.col("score").isNotNull(), F.row_number().over(w)))
    capped = F.col("score").isNotNull() & ((F.col("place") <= per_type) | F.col("type").isNull())
    zones = ranked.groupBy("region", "zone_id").agg(F.count("*").alias("n"), F.count_if(capped).alias("representatives"), F.avg(F.when(capped, F.col("score"))).alias("zone_score"))
    fit = zones.filter((F.col("n") >= min_members) & (F.col("representatives") > 0))
    return round_robin(fit, "region", max_zones, F.desc("zone_score"), F.asc("zone_id"))


def launch_scores(reach: DataFrame, top_n: int, max_m: float, weights: tuple[float, float, float, float] = (0.45, 0.25, 0.2, 0.1)) -> DataFrame:
    """Score of each launch by its best candidates: their quality, the way to them, the share in range, and access.

    ``reach``: (launch_id, name, verified, candidate_id, quality, metres).
    """
    top = first_per_key_n(reach, ["launch_id"], top_n, F.desc("quality"), F.asc("candidate_id"))
    s = top.groupBy("launch_id", "name", "verified").agg(F.avg("quality").alias("coverage"), F.avg("metres").alias("mean_m"), (F.count_if(F.col("metres") <= max_m) / F.count("*")).alias("feasible"))
    travel = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("mean_m") / max_m))
    access = F.when(F.col("verified"), 0.85).otherwise(0.55)
    a, b, c, e = weights
    return s.withColumn("score", a * F.col("coverage") + b * travel + c * F.col("feasible") + e * access)


def first_per_key_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def covered_cells(df: DataFrame, west, south, east, north, cell_deg: float) -> DataFrame:
    """A row (_x, _y) for each cell that a box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / cell_deg), F.floor(hi / cell_deg))
    return df.withColumn("_x", F.explode(span(west, east))).withColumn("_y", F.explode(span(south, north)))


def near_boxes(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, reach_deg: float = 0.0, cell_deg: float = 0.05) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose boxes (structs ``a`` and ``b`` of west, south, east, north) touch once ``a`` is widened by ``reach_deg``.

    Both sides go to the cells that they cover and meet by equality; of the
    cells that both cover, the first one gives the pair.
    """
    low, high = ("west", "south"), ("east", "north")
    wide = {c: F.col(f"{a}.{c}") - reach_deg for c in low} | {c: F.col(f"{a}.{c}") + reach_deg for c in high}
    met = covered_cells(left, *wide.values(), cell_deg).join(covered_cells(right, *[F.col(f"{b}.{c}") for c in (*low, *high)], cell_deg), [*keys, "_x", "_y"])
    first = lambda c: F.floor(F.greatest(wide[c], F.col(f"{b}.{c}")) / cell_deg)
    touch = (wide["west"] <= F.col(f"{b}.east")) & (wide["east"] >= F.col(f"{b}.west")) & (wide["south"] <= F.col(f"{b}.north")) & (wide["north"] >= F.col(f"{b}.south"))
    return met.filter(touch & (F.col("_x") == first("west")) & (F.col("_y") == first("south"))).drop("_x", "_y")


def tracks_in_circles(tracks: DataFrame, places: DataFrame, keys: list[str], radius_m: float, at_lat: float, deal: str, cell_deg: float = 0.02) -> DataFrame:
    """Tracks (x1, y1, x2, y2 in degrees) with the spots whose circle they touch: ``place_ids`` of the places (place_id, lon, lat) there, and ``share`` of their length inside it.

    Lengths are planar with the scale of ``at_lat``. Tracks are repeated to
    the cells that their way comes near to, places lie in one cell each, so each pair
    meets once and by equality; places of one spot meet a track once. A track
    without length counts whole or not. Tracks of a cell are dealt over tasks by
    the column ``deal``; rows stay dealt by ``keys``, the cell (_x, _y) and _deal, so
    sums by these and more do not move them.
    """
    sx, sy = METRES_PER_DEGREE * F.cos(F.radians(F.lit(at_lat))), F.lit(METRES_PER_DEGREE)
    wide_x, wide_y = radius_m / sx, radius_m / sy
    ways = tracks.withColumns({"_dx": (F.col("x2") - F.col("x1")) * sx, "_dy": (F.col("y2") - F.col("y1")) * sy}).withColumn("_a", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    t = covered_cells(ways, F.least("x1", "x2") - wide_x, F.least("y1", "y2") - wide_y, F.greatest("x1", "x2") + wide_x, F.greatest("y1", "y2") + wide_y, cell_deg)
    # Of the cells of its box a track goes to those whose middle lies within half a diagonal and the radius of it.
    mx, my = ((F.col("_x") + 0.5) * cell_deg - F.col("x1")) * sx, ((F.col("_y") + 0.5) * cell_deg - F.col("y1")) * sy
    along = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(mx * F.col("_dx") + my * F.col("_dy"), F.col("_a")))), F.lit(0.0))
    t = t.filter(F.hypot(mx - along * F.col("_dx"), my - along * F.col("_dy")) <= (radius_m + F.hypot(sx, sy) * cell_deg / 2) * 1.001)
    spots = places.groupBy(*keys, "lon", "lat").agg(F.collect_list("place_id").alias("place_ids"))
    spots = spots.withColumns({"_x": F.floor(F.col("lon") / cell_deg), "_y": F.floor(F.col("lat") / cell_deg), "_deal": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long")))})
    fx, fy = (F.col("x1") - F.col("lon")) * sx, (F.col("y1") - F.col("lat")) * sy
    a, b, c = F.col("_a"), 2 * (fx * F.col("_dx") + fy * F.col("_dy")), fx * fx + fy * fy - radius_m * radius_m
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    low, high = F.greatest(F.lit(0.0), F.try_divide(-b - root, 2 * a)), F.least(F.lit(1.0), F.try_divide(-b + root, 2 * a))
    share = F.when(a > 0, F.when(b * b - 4 * a * c > 0, F.greatest(F.lit(0.0), high - low)).otherwise(0.0)).otherwise(F.when(c <= 0, 1.0).otherwise(0.0))
    # A cell's pairs are many times its rows, so a cell's deals keep a task of their own as far as partitions go.
    cells = [*keys, "_x", "_y", "_deal"]
    dealt = t.withColumn("_deal", F.pmod(F.xxhash64(deal), F.lit(DEALT))).repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cells)
    return dealt.join(spots.hint("merge"), cells).select(*tracks.columns, "_x", "_y", "_deal", "place_ids", share.alias("share"))


def containment_parent(shapes: DataFrame, keys: list[str], cell_deg: float = 0.02) -> DataFrame:
    """``parent_id`` of each box (shape_id, west, south, east, north): the smallest other one that holds it; null for none.

    A box is held only by one that covers the cell of its middle.
    """
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    child = shapes.withColumns({"_x": F.floor((F.col("west") + F.col("east")) / 2 / cell_deg), "_y": F.floor((F.col("south") + F.col("north")) / 2 / cell_deg)})
    outer = covered_cells(shapes, F.col("west"), F.col("south"), F.col("east"), F.col("north"), cell_deg).select(*keys, "_x", "_y", F.col("shape_id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in ("west", "south", "east", "north")], area.alias("o_area"))
    holds = (F.col("o_west") <= F.col("west")) & (F.col("o_south") <= F.col("south")) & (F.col("o_east") >= F.col("east")) & (F.col("o_north") >= F.col("north")) & (F.col("o_area") > area)
    parents = child.join(outer, [*keys, "_x", "_y"]).filter(holds & (F.col("o_id") != F.col("shape_id"))).groupBy(*keys, "shape_id").agg(F.min_by("o_id", F.struct("o_area", "o_id")).alias("parent_id"))
    return shapes.join(parents, [*keys, "shape_id"], "left")


def shoreline_prominence(vertices: DataFrame, window_m: float, at_lat: float) -> DataFrame:
    """``prominence`` of each vertex: its distance from the chord between the vertices a window before and after it.

    ``vertices``: (ring_id, i, lon, lat) in order. The two ends of a chord are
    as-of joins on the length along the shore; a vertex nearer to an end of the
    line than the window has none.
    """
    sx, sy = METRES_PER_DEGREE * F.cos(F.radians(F.lit(at_lat))), F.lit(METRES_PER_DEGREE)
    w = Window.partitionBy("ring_id").orderBy("i")
    step = F.coalesce(axis_distance(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    v = vertices.withColumn("step", step).withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")
    side = lambda sign: v.select("ring_id", F.col("i").alias("at_i"), F.col("lon").alias("x"), F.col("lat").alias("y"), (sign * F.col("along")).alias("t"), (sign * F.col("i")).alias("o"))
    both = as_of(v.withColumn("back", F.col("along") - window_m), side(1), ["ring_id"], "back", "t", "o", ["x", "y"], "a_")
    both = as_of(both.withColumn("ahead", -F.col("along") - window_m), side(-1), ["ring_id"], "ahead", "t", "o", ["x", "y"], "b_")
    px, py = (F.col("lon") - F.col("a_x")) * sx, (F.col("lat") - F.col("a_y")) * sy
    dx, dy = (F.col("b_x") - F.col("a_x")) * sx, (F.col("b_y") - F.col("a_y")) * sy
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(px * dx + py * dy, dx * dx + dy * dy))), F.lit(0.0))
    distance = F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
    return both.filter("a_x IS NOT NULL AND b_x IS NOT NULL").select(*vertices.columns, distance.alias("prominence"))
