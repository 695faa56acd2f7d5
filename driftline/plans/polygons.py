"""Queries of overlays: unions, hulls, overlaps and containment of polygons from a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import overlay
from driftline.operators.lineage import written
from driftline.plans.base import POINTS, points, query, table

#: An event is an L-shaped area on a grid of whole units: a box less its upper right part; twenty to a lake.
_SHAPES_SQL = """hashed AS (SELECT event_id AS id, event_id // 20 AS lake, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) AS h FROM events),
shapes AS (SELECT id, lake, h % 60 AS x0, h % 60 + 4 + h // 3600 % 13 AS x1, h // 60 % 60 AS y0, h // 60 % 60 + 4 + h // 50000 % 13 AS y1, h % 60 + 2 + h // 7 % 3 AS xm, h // 60 % 60 + 2 + h // 11 % 3 AS ym FROM hashed),
boxes AS (SELECT id, lake, x0, x1, y0, ym AS y1 FROM shapes UNION ALL SELECT id, lake, x0, xm, ym, y1 FROM shapes)"""


def shapes(spark, d):
    """(id, lake, ring, x0, y0) of every event as an L-shaped ring."""
    h = F.conv(F.substr(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 20).alias("lake"), h.alias("h"))
    x0, y0 = F.col("h") % 60, F.floor(F.col("h") / 60) % 60
    places = {"x0": x0, "y0": y0, "x1": x0 + 4 + F.floor(F.col("h") / 3600) % 13, "y1": y0 + 4 + F.floor(F.col("h") / 50000) % 13, "xm": x0 + 2 + F.floor(F.col("h") / 7) % 3, "ym": y0 + 2 + F.floor(F.col("h") / 11) % 3}
    rows = rows.select("id", "lake", *[v.cast("double").alias(k) for k, v in places.items()])
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "ym"), ("xm", "ym"), ("xm", "y1"), ("x0", "y1"))
    return rows.select("id", "lake", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]).alias("ring"), "x0", "y0")


@query(
    f"""WITH {_SHAPES_SQL}, xs AS (SELECT DISTINCT lake, unnest([x0, x1]) AS x FROM boxes), ys AS (SELECT DISTINCT lake, unnest([y0, y1]) AS y FROM boxes),
columns AS (SELECT lake, x, lead(x) OVER (PARTITION BY lake ORDER BY x) AS x1 FROM xs), levels AS (SELECT lake, y, lead(y) OVER (PARTITION BY lake ORDER BY y) AS y1 FROM ys),
cells AS (SELECT c.lake, c.x, x1, l.y, y1, EXISTS (SELECT 1 FROM boxes b WHERE b.lake = c.lake AND b.x0 <= c.x AND b.x1 >= c.x1 AND b.y0 <= l.y AND b.y1 >= l.y1) AS full_
  FROM columns c JOIN levels l USING (lake) WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
quarters AS (SELECT lake, unnest([{{'x': x, 'y': y, 'q': 1}}, {{'x': x1, 'y': y, 'q': 2}}, {{'x': x, 'y': y1, 'q': 4}}, {{'x': x1, 'y': y1, 'q': 8}}], recursive := true) FROM cells WHERE full_),
corners AS (SELECT lake, x, y FROM quarters GROUP BY lake, x, y HAVING sum(q) IN (1, 2, 4, 8, 7, 11, 13, 14, 6, 9)),
spots AS (SELECT DISTINCT lake, x0 AS x, y0 AS y FROM shapes),
sides AS (SELECT p.lake, p.x, p.y, q.x AS u, q.y AS v FROM spots p JOIN spots q ON p.lake = q.lake AND (p.x, p.y) <> (q.x, q.y)
  WHERE NOT EXISTS (SELECT 1 FROM spots r WHERE r.lake = p.lake AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
    OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0)))),
unions AS (SELECT lake, CAST(sum((x1 - x) * (y1 - y)) AS DOUBLE) AS union_area FROM cells WHERE full_ GROUP BY lake),
outlines AS (SELECT lake, count(*) AS corners, CAST(sum(x * 1000 + y) AS DOUBLE) AS corner_sum FROM corners GROUP BY lake),
hulls AS (SELECT lake, count(*) AS hull_corners, sum(x * v - u * y) / 2.0 AS hull_area FROM sides GROUP BY lake)
SELECT lake, union_area, corners, corner_sum, hull_corners, hull_area FROM unions JOIN outlines USING (lake) JOIN hulls USING (lake)"""
)
def geo_union_hull(spark, d):
    """Union of each lake's areas and convex hull of their lower left corners: sizes and corners."""
    them = shapes(spark, d)
    rings = them.select(F.col("lake").alias("key"), F.col("id").alias("shape"), "ring")
    gaps = written(overlay.slabs(rings, 8.0, overlay.has_slopes(rings)))
    corners = overlay.outline_corners(gaps).groupBy("key").agg(F.count("*").alias("corners"), F.sum(F.col("x") * 1000 + F.col("y")).alias("corner_sum"))
    hulls = overlay.hulls(them.select(F.col("lake").alias("key"), F.col("x0").alias("x"), F.col("y0").alias("y")))
    joined = overlay.areas(gaps).join(corners, "key").join(hulls, "key")
    return joined.select(F.col("key").alias("lake"), F.col("union").alias("union_area"), "corners", "corner_sum", F.col("n").alias("hull_corners"), F.col("area").alias("hull_area"))


@query(
    f"""WITH {_SHAPES_SQL}, sizes AS (SELECT id, sum((x1 - x0) * (y1 - y0)) AS size FROM boxes GROUP BY id),
shared AS (SELECT a.lake, a.id AS left_id, b.id AS right_id, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS shared FROM boxes a JOIN boxes b ON a.lake = b.lake AND a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY ALL)
SELECT lake, left_id, right_id, CAST(shared AS DOUBLE) AS shared, shared / (l.size + r.size - shared) AS iou FROM shared JOIN sizes l ON l.id = left_id JOIN sizes r ON r.id = right_id WHERE shared > 0"""
)
def geo_ring_iou(spark, d):
    """Overlaps of two tables of rings that are no boxes."""
    them = shapes(spark, d).select("lake", "id", "ring")
    return overlay.overlaps(them.filter("id % 2 = 0"), them.filter("id % 2 = 1"), ["lake"], 8.0)


@query(
    f"""WITH {_SHAPES_SQL}, spots AS (SELECT id AS point_id, lake, (h // 13 % 740) / 10.0 + 0.05 AS x, (h // 17 % 740) / 10.0 + 0.05 AS y FROM hashed)
SELECT point_id, id AS ring_id FROM spots JOIN boxes ON spots.lake = boxes.lake AND x > x0 AND x < x1 AND y > y0 AND y < y1"""
)
def join_points_in_rings(spark, d):
    """Points with every ring of their lake that holds them, out of a table of rings."""
    h = F.conv(F.substr(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long")
    spots = table(spark, d, "events").select(F.col("event_id").alias("point_id"), F.floor(F.col("event_id") / 20).alias("lake"), h.alias("h")).select("point_id", "lake", *[(F.floor(F.col("h") / n) % 740 / F.lit(10.0) + 0.05).alias(c) for n, c in ((13, "x"), (17, "y"))])
    return overlay.points_in_rings(spots, shapes(spark, d).select("lake", F.col("id").alias("ring_id"), "ring"), 8.0, ("lake",)).select("point_id", "ring_id")


_DAYS_SQL = f"""{POINTS}, spots AS (SELECT session_id, at // 259200 AS part, point_id % 100 AS x, point_id % 97 AS y, row_number() OVER (PARTITION BY session_id, at // 259200 ORDER BY at, point_id) AS i, count(*) OVER (PARTITION BY session_id, at // 259200) AS n FROM points),
sides AS (SELECT a.session_id, a.part, a.n, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM spots a JOIN spots b ON a.session_id = b.session_id AND a.part = b.part AND b.i = a.i % a.n + 1)"""
_TURN = "sign(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


def _apart(a, b):
    at = lambda r: _TURN.format(p=f"{a}.p", q=f"{a}.q", r=f"{b}.{r}")
    return f"{at('p')} * {at('q')} < 0"


@query(
    f"""WITH {_DAYS_SQL}, crossed AS (SELECT a.session_id, a.part, count(*) AS crossings FROM sides a JOIN sides b ON a.session_id = b.session_id AND a.part = b.part AND (a.px, a.py, a.qx, a.qy) < (b.px, b.py, b.qx, b.qy) AND {_apart("a", "b")} AND {_apart("b", "a")} WHERE a.n > 3 GROUP BY 1, 2)
SELECT DISTINCT session_id, part, n AS vertices, coalesce(crossings, 0) AS crossings FROM spots LEFT JOIN crossed USING (session_id, part)"""
)
def geo_self_crossing(spark, d):
    """How often the ring of each session's three days crosses itself."""
    part = F.floor(F.col("at") / 259_200)
    spot = F.struct("at", "point_id", (F.col("point_id") % 100).cast("double").alias("x"), (F.col("point_id") % 97).cast("double").alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(spot)), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    rings = points(spark, d).groupBy("session_id", part.alias("part")).agg(ring.alias("ring")).withColumn("key", F.struct("session_id", "part"))
    found = overlay.ring_crossings(rings, 20.0)
    return rings.select("key", F.size("ring").cast("long").alias("vertices")).join(found, "key", "left").select("key.*", "vertices", F.coalesce("crossings", F.lit(0)).alias("crossings"))


_LINES_SQL = """hashed AS (SELECT event_id AS line_id, event_id // 60 AS lake, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) AS h FROM events),
lines AS (SELECT line_id, lake, h % 12 AS ax, h // 12 % 12 AS ay, h // 144 % 12 AS bx, h // 1728 % 12 AS by_ FROM hashed),
ends AS (SELECT lake, line_id, ax AS x, ay AS y FROM lines UNION ALL SELECT lake, line_id, bx, by_ FROM lines),
spots AS (SELECT lake, x, y, count(*) AS n, min(line_id) AS a, max(line_id) AS b FROM ends GROUP BY 1, 2, 3),
tied AS (SELECT a, b FROM spots WHERE n = 2 AND a <> b UNION SELECT b, a FROM spots WHERE n = 2 AND a <> b)"""


@query(
    f"""WITH RECURSIVE {_LINES_SQL}, reach AS (SELECT line_id AS a, line_id AS b FROM lines UNION SELECT r.a, t.b FROM reach r JOIN tied t ON t.a = r.b),
chains AS (SELECT a AS line_id, min(b) AS merged_id FROM reach GROUP BY 1),
loose AS (SELECT merged_id, count(*) FILTER (WHERE n <> 2) = 0 AS closed FROM ends JOIN spots USING (lake, x, y) JOIN chains USING (line_id) GROUP BY 1)
SELECT merged_id, closed, count(*) AS lines, round(sum(sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))), 6) AS length FROM lines JOIN chains USING (line_id) JOIN loose USING (merged_id) GROUP BY 1, 2"""
)
def geo_line_merge(spark, d):
    """Lines of a lake merged into chains where two of their ends meet."""
    h = F.conv(F.substr(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("long")
    rows = table(spark, d, "events").select(F.col("event_id").alias("line_id"), F.floor(F.col("event_id") / 60).alias("lake"), h.alias("h"))
    lines = rows.select("line_id", "lake", *[(F.floor(F.col("h") / n) % 12).alias(c) for n, c in ((1, "ax"), (12, "ay"), (144, "bx"), (1728, "by"))])
    length = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return overlay.merged_lines(lines, ("lake",)).groupBy("merged_id", "closed").agg(F.count("*").alias("lines"), F.round(F.sum(length), 6).alias("length"))
