"""Distance models and planar geometry as column expressions.

Three models coexist on purpose, and an operator uses the one that is its own:
mean-scale degrees, separate-axis degrees, and the haversine. Distances are in
metres, positions in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of a degree, and the radius of the haversine's sphere.
METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS_M = 6_371_000.0
COS_MIN_LAT = 0.0


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_scale_distance(lon1, lat1, lon2, lat2) -> Column:
    """Length in degrees times the mean of the two axes' scales at the middle latitude."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    scale = (METRES_PER_DEGREE + METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))) / 2
    return F.sqrt((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)) * scale


def axis_distance(lon1, lat1, lon2, lat2) -> Column:
    """Each axis with its own scale."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    half = lambda d: F.sin(F.radians(d) / 2)
    a = half(lat2 - lat1) * half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1) * half(lon2 - lon1)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Degrees from north, clockwise, on the plane."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)) + 360, F.lit(360.0))


def full_circle(angle) -> Column:
    """An angle in [0, 360): the remainder of SQL's ``fmod``, which is not negative, and a turn added to every one, which rounds off what arithmetic left behind a half or a whole turn."""
    rest = _col(angle) % 360.0
    return (F.when(rest < 0, rest + 360.0).otherwise(rest) + 360.0) % 360.0


def signed_delta(a, b) -> Column:
    """The turn from bearing a to bearing b, in (-180, 180]."""
    turn = full_circle(_col(b) - _col(a))
    return F.when(turn > 180, turn - 360).otherwise(turn)


def utm_zone(lon) -> Column:
    return F.least(F.greatest(F.floor((_col(lon) + 180) / 6) + 1, F.lit(1)), F.lit(60)).cast("int")


def grid_cell(lon, lat, metres: float, at_lat: float) -> tuple[Column, Column]:
    """Indices of square cells of about ``metres``; the longitude scale is that of ``at_lat``."""
    dx = metres / (METRES_PER_DEGREE * math.cos(math.radians(at_lat)))
    dy = metres / METRES_PER_DEGREE
    return F.floor(_col(lon) / dx).cast("long"), F.floor(_col(lat) / dy).cast("long")


def in_box(lon, lat, west, south, east, north) -> Column:
    return _col(lon).between(west, east) & _col(lat).between(south, north)


def in_ring(x, y, ring) -> Column:
    """Whether a point lies in a ring, an array of (x, y) structs, by the parity of crossings."""
    x, y, ring = _col(x), _col(y), _col(ring)
    following = ring_following(ring)
    crossed = F.zip_with(ring, following, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crossed, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def ring_area(ring) -> Column:
    """Planar area of a ring of (x, y) structs, in its own units."""
    ring = _col(ring)
    following = ring_following(ring)
    terms = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)) / 2


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes given as structs of west, south, east, north."""
    w = F.greatest(F.least(f"{a}.east", f"{b}.east") - F.greatest(f"{a}.west", f"{b}.west"), F.lit(0.0))
    h = F.greatest(F.least(f"{a}.north", f"{b}.north") - F.greatest(f"{a}.south", f"{b}.south"), F.lit(0.0))
    area = lambda s: (F.col(f"{s}.east") - F.col(f"{s}.west")) * (F.col(f"{s}.north") - F.col(f"{s}.south"))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def ring_following(ring: Column) -> Column:
    """Each vertex's next one, the last one's being the first."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))


def distance_to_ring(x, y, ring, at_lat: float) -> Column:
    """Metres from a point to a ring's nearest edge, on the plane with the scale of ``at_lat``."""
    x, y, ring = _col(x), _col(y), _col(ring)
    sx, sy = METRES_PER_DEGREE * math.cos(math.radians(at_lat)), METRES_PER_DEGREE

    def edge(a: Column, b: Column) -> Column:
        px, py, dx, dy = (x - a["x"]) * sx, (y - a["y"]) * sy, (b["x"] - a["x"]) * sx, (b["y"] - a["y"]) * sy
        t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(px * dx + py * dy, dx * dx + dy * dy))), F.lit(0.0))
        return F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))

    return F.array_min(F.zip_with(ring, ring_following(ring), edge))


def path_length(path, at_lat: float) -> Column:
    """Metres along an array of (x, y) structs."""
    path = _col(path)
    sx, sy = METRES_PER_DEGREE * math.cos(math.radians(at_lat)), METRES_PER_DEGREE
    following = F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), following, lambda a, b: F.sqrt(((b["x"] - a["x"]) * sx) * ((b["x"] - a["x"]) * sx) + ((b["y"] - a["y"]) * sy) * ((b["y"] - a["y"]) * sy)))
    return F.aggregate(steps, F.lit(0.0), lambda total, s: total + s)


def hausdorff(a, b) -> Column:
    """Discrete Hausdorff distance of two arrays of (x, y) structs, in their own units."""
    gap = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    farthest = lambda one, other: F.array_max(F.transform(one, lambda p: F.array_min(F.transform(other, lambda q: gap(p, q)))))
    return F.greatest(farthest(_col(a), _col(b)), farthest(_col(b), _col(a)))


def web_mercator(lon, lat) -> tuple[Column, Column]:
    """Metres of the spherical Mercator projection."""
    radius = 6_378_137.0
    return F.radians(_col(lon)) * radius, F.log(F.tan(math.pi / 4 + F.radians(_col(lat)) / 2)) * radius


# Fixed values of the WGS84 ellipsoid and the transverse Mercator grid.
_A, _F, _K0 = 6_378_137.0, 1 / 298.257223563, 0.9996


def utm(lon, lat) -> dict[str, Column]:
    """Zone, easting and northing of the northern UTM grid by the usual series (Snyder 1987)."""
    lon, lat = _col(lon), F.radians(_col(lat))
    zone = utm_zone(lon)
    e2 = _F * (2 - _F)
    ep2 = e2 / (1 - e2)
    n = _A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    t, c = F.tan(lat) * F.tan(lat), ep2 * F.cos(lat) * F.cos(lat)
    a = F.cos(lat) * F.radians(lon - (zone * 6 - 183))
    m = _A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * lat) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * lat) - 35 * e2**3 / 3072 * F.sin(6 * lat))
    east = 500_000 + _K0 * n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a * a * a * a * a / 120)
    north = _K0 * (m + n * F.tan(lat) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a * a * a * a / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a * a * a * a * a * a / 720))
    return {"zone": zone, "easting": east, "northing": north}


def to_wgs84(srid, lon, lat) -> dict[str, Column]:
    """Positions of WGS84 and of NAD83 (SRID 4269), which differ by less than the data's error; others are refused as null."""
    known = _col(srid).isin(4326, 4269)
    return {"lon": F.when(known, _col(lon)), "lat": F.when(known, _col(lat)), "refused": ~F.coalesce(known, F.lit(False))}


def closed_ring(path, tolerance: float) -> Column:
    """The path with its first vertex put at its end where the two are within the tolerance; null where they are not, or it is too short."""
    path = _col(path)
    first, last = F.element_at(path, 1), F.element_at(path, -1)
    gap = F.sqrt((first["x"] - last["x"]) * (first["x"] - last["x"]) + (first["y"] - last["y"]) * (first["y"] - last["y"]))
    return F.when((F.size(path) >= 4) & (gap <= tolerance), F.concat(F.slice(path, F.lit(1), F.size(path) - 1), F.array(first)))


def ring_faults(ring) -> Column:
    """Why an array of (x, y) structs is no ring: EMPTY, TOO_SHORT, NOT_FINITE, OPEN, NO_AREA; null if it is one."""
    ring = _col(ring)
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    odd = F.exists(ring, lambda v: v["x"].isNull() | v["y"].isNull() | F.isnan(v["x"]) | F.isnan(v["y"]) | (F.abs(v["x"]) == float("inf")) | (F.abs(v["y"]) == float("inf")))
    return F.when(ring.isNull() | (F.size(ring) == 0), "EMPTY").when(F.size(ring) < 4, "TOO_SHORT").when(odd, "NOT_FINITE").when((first["x"] != last["x"]) | (first["y"] != last["y"]), "OPEN").when(ring_area(ring) <= 0, "NO_AREA")


def buffer_degrees(metres, lat) -> Column:
    """Degrees of a buffer by the mean of the two axes' scales."""
    return F.lit(metres) / ((METRES_PER_DEGREE + METRES_PER_DEGREE * F.cos(F.radians(_col(lat)))) / 2)
