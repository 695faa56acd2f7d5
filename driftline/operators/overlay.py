"""Overlays of polygons by slabs, hulls as mergeable aggregates, and points met with tables of rings.

A shape is any number of rings, inside by the even-odd rule, so holes are rings
like others. The plane is cut into strips, each strip at every corner and
crossing inside it; between two cuts no edges cross, so the shapes of a slab are
trapezoids in the order of their middles. How many shapes lie over a trapezoid
is a running sum. Unions, intersections and differences are choices of depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftline.functions.geo import in_ring, ring_following
from driftline.operators.graph import connected

#: Digits to which corners of one place agree.
DIGITS = 9


def edges_of(shapes: DataFrame) -> DataFrame:
    """(key, shape, ax, ay, bx, by) of the sides of ``shapes`` (key, shape, ring array<struct<x, y>>), from left to right; upright sides bound no slab and go."""
    sides = shapes.filter(F.size("ring") > 2).select("key", "shape", F.explode(F.arrays_zip(F.col("ring").alias("p"), ring_following(F.col("ring")).alias("q"))).alias("side"))
    flip = F.col("side.p.x") > F.col("side.q.x")
    pick = lambda first, c: F.when(flip == first, F.col(f"side.q.{c}")).otherwise(F.col(f"side.p.{c}")).cast("double")
    return sides.select("key", "shape", pick(True, "x").alias("ax"), pick(True, "y").alias("ay"), pick(False, "x").alias("bx"), pick(False, "y").alias("by")).filter("ax < bx")


def _over(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width), F.floor(high / width))


def _height(x: Column) -> Column:
    """A side's y at x; exactly that of its corners there."""
    return F.when(x == F.col("ax"), F.col("ay")).when(x == F.col("bx"), F.col("by")).otherwise(F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / (F.col("bx") - F.col("ax")))


def _crossings(edges: DataFrame, width: float) -> DataFrame:
    """(key, x) where two sides of one key cross; sides meet by the cells that their boxes cover. Two level ones don't cross, so one of a pair is none."""
    cells = edges.withColumn("side", F.struct("ax", "ay", "bx", "by")).withColumn("cx", F.explode(_over(F.col("ax"), F.col("bx"), width))).withColumn("cy", F.explode(_over(F.least("ay", "by"), F.greatest("ay", "by"), width)))
    of = lambda n: cells.select("key", "cx", "cy", F.col("side").alias(n))
    # of the cells that two cover, the first gives the pair
    first = (F.col("cx") == F.floor(F.greatest("p.ax", "q.ax") / width)) & (F.col("cy") == F.floor(F.greatest(F.least("p.ay", "p.by"), F.least("q.ay", "q.by")) / width))
    met = of("p").filter("p.ay <> p.by").join(of("q"), ["key", "cx", "cy"]).filter(F.expr("q.ay = q.by OR p < q") & first)
    pairs = met.select("key", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    slope = lambda s: (F.col(f"{s}.by") - F.col(f"{s}.ay")) / (F.col(f"{s}.bx") - F.col(f"{s}.ax"))
    x = F.try_divide(F.col("b.ay") - slope("b") * F.col("b.ax") - F.col("a.ay") + slope("a") * F.col("a.ax"), slope("a") - slope("b"))  # null where they are parallel
    return pairs.select("key", x.alias("x"), F.greatest("a.ax", "b.ax").alias("low"), F.least("a.bx", "b.bx").alias("high")).filter("x > low AND x < high").select("key", "x")


def has_slopes(shapes: DataFrame) -> bool:
    """Whether a side of ``shapes`` is neither level nor upright; where none is, no sides cross inside a slab."""
    return not edges_of(shapes).filter("ay <> by").isEmpty()


def slabs(shapes: DataFrame, width: float, slopes: bool = True) -> DataFrame:
    """(key, x0, x1, y0, y1, up0, up1, depth, below, slope, next_slope) of the gaps between sides that follow each other upwards in a slab.

    ``y0, y1`` are the lower side's heights at the two cuts, ``up0, up1`` the
    upper one's (null above the last); ``depth`` shapes lie over the gap, and
    ``below`` under its lower side. ``width`` is that of a strip: a few sides
    should span one. Sides move once, to their strips, and stay there; without
    ``slopes`` (:func:`has_slopes`) none are asked whether they cross.
    """
    edges = edges_of(shapes)
    strips = edges.withColumn("strip", F.explode(_over(F.col("ax"), F.col("bx"), width)))
    sides = strips.withColumns({"low": F.round(F.greatest("ax", F.col("strip") * width), DIGITS), "high": F.round(F.least("bx", (F.col("strip") + 1) * width), DIGITS)})
    if slopes:
        crossed = _crossings(edges, width).select("key", F.floor(F.col("x") / width).alias("strip"), F.round("x", DIGITS).alias("low"), F.round("x", DIGITS).alias("high"))
        sides = sides.unionByName(crossed, allowMissingColumns=True)
    cuts = F.collect_set(F.array("low", "high")).over(Window.partitionBy("key", "strip"))
    sides = sides.withColumn("cuts", cuts).filter("ax IS NOT NULL").withColumn("cuts", F.sort_array(F.array_distinct(F.flatten("cuts"))))
    spans = F.arrays_zip(F.col("cuts").alias("x0"), F.slice("cuts", 2, F.size("cuts")).alias("x1"))
    within = F.filter(spans, lambda s: (F.col("low") <= s["x0"]) & (F.col("high") >= s["x1"]))
    sides = sides.select("key", "strip", "shape", "ax", "ay", "bx", "by", F.inline(within))
    at = lambda x: _height(F.greatest("ax", F.least("bx", x)))
    slope = F.round((F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")), DIGITS)
    sides = sides.select("key", "strip", "shape", "x0", "x1", at(F.col("x0")).alias("y0"), at(F.col("x1")).alias("y1"), slope.alias("slope")).withColumn("middle", F.round(F.col("y0") + F.col("y1"), DIGITS))
    # A span lies in one strip, which is named to keep it where it is.
    own = Window.partitionBy("key", "strip", "x0", "shape").orderBy("middle")
    step = sides.withColumn("step", F.when(F.row_number().over(own) % 2 == 1, 1).otherwise(-1))
    order = Window.partitionBy("key", "strip", "x0").orderBy("middle", F.desc("step"), "shape")
    depth = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return step.select("key", "x0", "x1", "y0", "y1", F.lead("y0").over(order).alias("up0"), F.lead("y1").over(order).alias("up1"), depth.alias("depth"), (depth - F.col("step")).alias("below"), "slope")


def area() -> Column:
    """Area of a gap of :func:`slabs`."""
    return F.coalesce((F.col("up0") - F.col("y0") + F.col("up1") - F.col("y1")) / 2 * (F.col("x1") - F.col("x0")), F.lit(0.0))


def areas(gaps: DataFrame) -> DataFrame:
    """(key, union, shared, most): area under one shape or more, under two or more, and the greatest depth, from :func:`slabs`."""
    deep = lambda n: F.sum(F.when(F.col("depth") >= n, area()).otherwise(0.0))
    return gaps.groupBy("key").agg(deep(1).alias("union"), deep(2).alias("shared"), F.max("depth").cast("long").alias("most"))


def outline_corners(gaps: DataFrame) -> DataFrame:
    """(key, x, y) of the corners of each key's union: where its outline doesn't go straight on."""
    rim = gaps.filter("(below = 0) <> (depth = 0)").withColumn("floor", F.col("below") == 0)
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(False).alias("left")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(True).alias("left")))
    met = rim.select("key", "floor", "slope", F.explode(ends).alias("e")).groupBy("key", F.round("e.x", DIGITS).alias("x"), F.round("e.y", DIGITS).alias("y"))
    # Least and greatest values are partial sums; distinct counts would move every end.
    one = lambda c: F.min(c).eqNullSafe(F.max(c))
    straight = (F.count("*") == 2) & ~one("e.left") & one("floor") & one("slope")
    return met.agg(straight.alias("straight")).filter("NOT straight").select("key", "x", "y")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(*keys, left_id, right_id, shared, iou) of shapes (*keys, id, ring) that overlap, met by the cells of their boxes."""

    def cells(df: DataFrame, side: str) -> DataFrame:
        edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
        boxed = df.select(*keys, F.col("id").alias(f"{side}_id"), F.col("ring").alias(side), *[edge(f, c).alias(n) for n, f, c in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"))])
        return boxed.withColumn("cx", F.explode(_over(F.col("x0"), F.col("x1"), width))).withColumn("cy", F.explode(_over(F.col("y0"), F.col("y1"), width))).select(*keys, f"{side}_id", side, F.struct("x0", "x1", "y0", "y1").alias(f"{side}_box"), "cx", "cy")

    met = cells(left, "left").join(cells(right, "right"), [*keys, "cx", "cy"])
    meets = " AND ".join(f"left_box.{c}0 < right_box.{c}1 AND right_box.{c}0 < left_box.{c}1" for c in "xy")
    # one of the cells that both cover speaks for the pair
    once = " AND ".join(f"c{c} = floor(greatest(left_box.{c}0, right_box.{c}0) / {width})" for c in "xy")
    pairs = met.filter(f"{meets} AND {once}").select(F.struct(*keys, "left_id", "right_id").alias("key"), "left", "right")
    shapes = pairs.select("key", F.explode(F.array(F.struct(F.lit(0).alias("shape"), F.col("left").alias("ring")), F.struct(F.lit(1).alias("shape"), F.col("right").alias("ring")))).alias("s")).select("key", "s.shape", "s.ring")
    found = areas(slabs(shapes, width)).filter("shared > 0")
    return found.select("key.*", "shared", (F.col("shared") / F.col("union")).alias("iou"))


def points_in_rings(points: DataFrame, rings: DataFrame, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (x, y, ...) with ``ring_id`` for every ring of the table ``rings`` (ring_id, ring) of equal ``keys`` that holds them, met by cells of the rings' boxes."""
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    covered = rings.filter(F.size("ring") > 2).withColumn("_x", F.explode(_over(edge(F.array_min, "x"), edge(F.array_max, "x"), width))).withColumn("_y", F.explode(_over(edge(F.array_min, "y"), edge(F.array_max, "y"), width))).select(*keys, "ring_id", "ring", "_x", "_y")
    met = points.withColumns({"_x": F.floor(F.col("x") / width), "_y": F.floor(F.col("y") / width)}).join(covered, [*keys, "_x", "_y"])
    return met.filter(in_ring("x", "y", "ring")).select(*points.columns, "ring_id")


def ring_crossings(rings: DataFrame, width: float) -> DataFrame:
    """(key, crossings) of rings (key, ring) two of whose sides cross inside both, met by the cells that sides cover."""
    side = F.posexplode(F.arrays_zip(F.col("ring").alias("p"), ring_following(F.col("ring")).alias("q"))).alias("i", "s")
    cell = lambda f, c: F.floor(f(F.col(f"s.p.{c}"), F.col(f"s.q.{c}")) / width)
    sides = rings.filter(F.size("ring") > 3).select("key", side).withColumns({"x0": cell(F.least, "x"), "y0": cell(F.least, "y"), "x1": cell(F.greatest, "x"), "y1": cell(F.greatest, "y")})
    sides = sides.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    of = lambda n: sides.select("key", "cx", "cy", F.struct("i", "x0", "y0").alias(f"{n}_at"), F.col("s").alias(n))
    # Sides are told apart by their places in the ring, so one that is run twice counts twice; of the cells that two cover, the first gives the pair.
    first = lambda c: F.col(f"c{c}") == F.greatest(f"a_at.{c}0", f"b_at.{c}0")
    pairs = of("a").join(of("b"), ["key", "cx", "cy"]).filter((F.col("a_at.i") < F.col("b_at.i")) & first("x") & first("y"))

    def turn(p: str, q: str, r: str) -> Column:
        return F.signum((F.col(f"{q}.x") - F.col(f"{p}.x")) * (F.col(f"{r}.y") - F.col(f"{p}.y")) - (F.col(f"{q}.y") - F.col(f"{p}.y")) * (F.col(f"{r}.x") - F.col(f"{p}.x")))

    apart = lambda a, b: turn(f"{a}.p", f"{a}.q", f"{b}.p") * turn(f"{a}.p", f"{a}.q", f"{b}.q") < 0
    return pairs.filter(apart("a", "b") & apart("b", "a")).groupBy("key").agg(F.count("*").alias("crossings"))


def merged_lines(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` (*keys, line_id, ax, ay, bx, by, ...) with ``merged_id``, the least line of the chain they belong to, and ``closed``.

    Lines are joined where the ends of just two meet; where more do, a chain
    ends. A chain is closed if no end of it is left.
    """
    ends = lines.select(*keys, "line_id", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("end"))
    spots = ends.groupBy(*keys, "end").agg(F.count("*").alias("n"), F.min("line_id").alias("a"), F.max("line_id").alias("b"))
    chains = connected(spots.filter("n = 2").select("a", "b")).select(F.col("id").alias("line_id"), "component")
    whole = lines.join(chains, "line_id", "left").withColumn("merged_id", F.coalesce("component", "line_id")).drop("component")
    loose = ends.join(spots.select(*keys, "end", "n"), [*keys, "end"]).join(whole.select("line_id", "merged_id"), "line_id").groupBy("merged_id").agg((F.sum(F.when(F.col("n") != 2, 1).otherwise(0)) == 0).alias("closed"))
    return whole.join(loose, "merged_id").select(*lines.columns, "merged_id", "closed")


def hull_of(spots: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, against the clock from the leftmost lowest; points on its sides are no corners."""
    pts = sorted(set(spots))
    if len(pts) < 3:
        return pts

    def chain(them: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in them:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


#: Points of a key that are held before they are reduced to their hull.
HELD = 4096


def _hulls_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(key, corners) of rows sorted by key, batch by batch; a key may go on in the next one."""
    key, spots, most = None, [], HELD
    for batch in batches:
        done = []
        for k, x, y in zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y"))):
            if spots and not (k == key or (k != k and key != key)):
                done.append((key, hull_of(spots)))
                spots, most = [], HELD
            key = k
            spots.append((x, y))
            if len(spots) >= most:
                spots = hull_of(spots)
                most = max(HELD, 2 * len(spots))
        yield done
    if spots:
        yield [(key, hull_of(spots))]


def hulls(points: DataFrame) -> DataFrame:
    """(key, n, area, ring) of each key's convex hull over ``points`` (key, x, y); ``n`` counts its corners.

    Hulls merge, so a key's rows are reduced where they lie, and what moves is
    corners: a key with most of the rows is no one task's load. Rows come in
    order of the key, so a task holds one key's corners at a time.
    """
    kind = dict(points.dtypes)["key"]

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _hulls_in_order(batches):
            flat = [(k, x, y) for k, ring in done for x, y in ring]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((key_type, pa.float64(), pa.float64()))], names=["key", "x", "y"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _hulls_in_order(batches):
            sizes = [abs(sum(x * v - u * y for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1]))) / 2 for _, ring in done]
            rings = pa.array([[{"x": x, "y": y} for x, y in ring] for _, ring in done], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], key_type), pa.array([len(ring) for _, ring in done], pa.int64()), pa.array(sizes, pa.float64()), rings], names=["key", "n", "area", "ring"])

    rows = points.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    key_type = to_arrow_type(rows.schema["key"].dataType)
    parts = rows.sortWithinPartitions("key").mapInArrow(corners, f"key {kind}, x double, y double")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(whole, f"key {kind}, n long, area double, ring array<struct<x: double, y: double>>")
