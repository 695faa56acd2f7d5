"""Queries of ways, zones and route choice over areas derived from the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import beam, routes, subplans, zones
from driftline.operators.spatial import within_radius
from driftline.plans.base import query, table
from driftline.plans.spatial import _axis_sql

#: Areas of 40 x 40 cells of 25 m; an event opens the cell that its id hashes to, so about seven in ten are open.
_AREA, _WIDE, CELL_M, MAX_M = 2000, 40, 25.0, 600.0
_CELLS_SQL = f"""hashed AS (SELECT event_id, event_type, event_id // {_AREA} AS area, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT) AS h FROM events),
placed AS (SELECT event_id, event_type, area, h % {_WIDE} AS x, h // {_WIDE} % {_WIDE} AS y FROM hashed),
cells AS (SELECT DISTINCT area, x, y FROM placed)"""


def placed(spark, d):
    """(event_id, area, x, y): the cell of every event."""
    h = F.conv(F.substr(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), F.lit(6)), 16, 10).cast("long")
    return table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / _AREA).alias("area"), h.alias("h")).select("event_id", "area", (F.col("h") % _WIDE).alias("x"), (F.floor(F.col("h") / _WIDE) % _WIDE).alias("y"))


@query(
    f"""WITH RECURSIVE {_CELLS_SQL}, moves AS (
  SELECT c.area, c.x, c.y, n.x AS nx, n.y AS ny, c.x <> n.x AND c.y <> n.y AS diagonal
  FROM cells c JOIN cells n ON n.area = c.area AND abs(n.x - c.x) <= 1 AND abs(n.y - c.y) <= 1 AND (n.x <> c.x OR n.y <> c.y)
  WHERE c.x = n.x OR c.y = n.y OR (EXISTS (SELECT 1 FROM cells o WHERE o.area = c.area AND o.x = n.x AND o.y = c.y) AND EXISTS (SELECT 1 FROM cells o WHERE o.area = c.area AND o.x = c.x AND o.y = n.y))
), pairs AS (
  SELECT * FROM (SELECT event_id, area, x AS sx, y AS sy, lead(x) OVER w AS gx, lead(y) OVER w AS gy FROM placed WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY area ORDER BY event_id)) WHERE gx IS NOT NULL
), best(area, sx, sy, x, y, straight, diagonal) USING KEY (area, sx, sy, x, y) AS (
  SELECT DISTINCT area, sx, sy, sx, sy, 0, 0 FROM pairs
  UNION
  SELECT t.area, t.sx, t.sy, t.x, t.y, t.straight, t.diagonal FROM (
    SELECT area, sx, sy, x, y, arg_min(straight, straight + diagonal * sqrt(2.0)) AS straight, arg_min(diagonal, straight + diagonal * sqrt(2.0)) AS diagonal FROM (
      SELECT b.area, b.sx, b.sy, m.nx AS x, m.ny AS y, b.straight + CASE WHEN m.diagonal THEN 0 ELSE 1 END AS straight, b.diagonal + CASE WHEN m.diagonal THEN 1 ELSE 0 END AS diagonal
      FROM best b JOIN moves m ON m.area = b.area AND m.x = b.x AND m.y = b.y) AS stepped
    WHERE (straight + diagonal * sqrt(2.0)) * {CELL_M} <= {MAX_M} GROUP BY area, sx, sy, x, y) AS t
  LEFT JOIN recurring.best AS old ON old.area = t.area AND old.sx = t.sx AND old.sy = t.sy AND old.x = t.x AND old.y = t.y
  WHERE old.straight IS NULL OR t.straight + t.diagonal * sqrt(2.0) < old.straight + old.diagonal * sqrt(2.0)
)
SELECT p.event_id, CAST(b.straight AS BIGINT) AS straight, CAST(b.diagonal AS BIGINT) AS diagonal, round((b.straight + b.diagonal * sqrt(2.0)) * {CELL_M}, 6) AS metres
FROM pairs p LEFT JOIN best b ON b.area = p.area AND b.sx = p.sx AND b.sy = p.sy AND b.x = p.gx AND b.y = p.gy"""
)
def alg_astar(spark, d):
    """Shortest ways from each purchase to the next one of its area over open cells: eight moves, no cut corners, a cut-off."""
    cells = placed(spark, d)
    w = Window.partitionBy("area").orderBy("event_id")
    spots = cells.join(table(spark, d, "events").filter("event_type = 'purchase'").select("event_id"), "event_id")
    pairs = spots.select("event_id", "area", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lead("x").over(w).alias("gx"), F.lead("y").over(w).alias("gy")).filter("gx IS NOT NULL")
    found = routes.shortest_ways(cells.select("area", "x", "y"), pairs, CELL_M, MAX_M)
    return found.select("event_id", "straight", "diagonal", F.round("metres", 6).alias("metres"))


#: Lakes of sixty places over 100 x 100 steps of about 25 m, each place with an area of its own.
_PLACES_SQL = f"""hashed AS (SELECT event_id AS id, event_id // 60 AS lake, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT) AS h FROM events),
places AS (SELECT id, lake, -79.0 + (h % 100) * 0.0003 AS lon, 44.0 + (h // 100 % 100) * 0.000225 AS lat, 1000.0 * (2 + h % 180) AS area_m2 FROM hashed),
links AS (SELECT a.lake, a.id AS i, b.id AS j, round({_axis_sql("a.lon", "a.lat", "b.lon", "b.lat")}, 3) AS metres FROM places a JOIN places b ON a.lake = b.lake AND a.id < b.id
  WHERE {_axis_sql("a.lon", "a.lat", "b.lon", "b.lat")} <= 480)"""


def lake_places(spark, d):
    """(id, lake, lon, lat, area_m2) of every event as a place."""
    h = F.conv(F.substr(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), F.lit(6)), 16, 10).cast("long")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 60).alias("lake"), h.alias("h"))
    return rows.select("id", "lake", (F.lit(-79.0) + F.col("h") % 100 * F.lit(0.0003)).alias("lon"), (F.lit(44.0) + F.floor(F.col("h") / 100) % 100 * F.lit(0.000225)).alias("lat"), (F.lit(1000.0) * (2 + F.col("h") % 180)).alias("area_m2"))


@query(
    f"""WITH RECURSIVE {_PLACES_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY lake ORDER BY id) AS p FROM places), lakes AS (
  SELECT lake, list(id ORDER BY id) AS ids, list(lon ORDER BY id) AS lons, list(lat ORDER BY id) AS lats, list(area_m2 ORDER BY id) AS areas FROM places GROUP BY lake
), walks AS (
  SELECT l.lake, list({{'p': a.p, 'q': b.p, 'm': metres}} ORDER BY metres, i, j) AS links FROM links l JOIN numbered a ON a.id = i JOIN numbered b ON b.id = j GROUP BY l.lake
), walk AS (
  SELECT lake, 1 AS n, range(1, len(ids) + 1) AS root, list_transform(ids, lambda x: 0.0 :: DOUBLE) AS long, list_transform(ids, lambda x: 0.0 :: DOUBLE) AS gap,
    list_transform(ids, lambda x, v: list_transform(ids, lambda y, u: CASE WHEN u = v THEN 0.0 :: DOUBLE END)) AS far
  FROM lakes
  UNION ALL
  SELECT lake, n + 1,
    CASE WHEN fits THEN list_transform(root, lambda r: CASE WHEN r = greatest(rp, rq) THEN least(rp, rq) ELSE r END) ELSE root END,
    CASE WHEN fits THEN list_transform(long, lambda x, v: CASE WHEN v = least(rp, rq) THEN tree ELSE x END) ELSE long END,
    CASE WHEN fits THEN list_transform(gap, lambda x, v: CASE WHEN v = least(rp, rq) THEN wide ELSE x END) ELSE gap END,
    CASE WHEN fits THEN list_transform(far, lambda row, v: list_transform(row, lambda x, u: CASE WHEN root[v] = rp AND root[u] = rq THEN row[p] + whole + far[q][u] WHEN root[v] = rq AND root[u] = rp THEN row[q] + whole + far[p][u] ELSE x END)) ELSE far END
  FROM (
    SELECT *, rp <> rq AND greatest(tree, box) <= 900 AND wide <= 450 AND len(members) / greatest(area / 1e6, 1e-6) >= 6 AND (area <= 1 OR greatest(tree, box) / sqrt(area) <= 8) AS fits
    FROM (
      SELECT *, greatest(long[rp], long[rq], list_max(far[p]) + whole + list_max(far[q])) AS tree, greatest(gap[rp], gap[rq], m) AS wide, list_sum(list_transform(members, lambda v: areas[v])) AS area,
        sqrt(pow((list_max(ys) - list_min(ys)) * 111320.0, 2) + pow((list_max(xs) - list_min(xs)) * 111320.0 * cos(radians((list_max(ys) + list_min(ys)) / 2)), 2)) AS box
      FROM (
        SELECT *, list_transform(members, lambda v: lons[v]) AS xs, list_transform(members, lambda v: lats[v]) AS ys
        FROM (
          SELECT *, list_filter(range(1, len(root) + 1), lambda v: root[v] IN (rp, rq)) AS members
          FROM (SELECT w.*, l.lons, l.lats, l.areas, s.links[n].p AS p, s.links[n].q AS q, s.links[n].m AS m, floor(s.links[n].m + 0.5) AS whole, root[s.links[n].p] AS rp, root[s.links[n].q] AS rq
            FROM walk w JOIN lakes l USING (lake) JOIN walks s USING (lake) WHERE n <= len(s.links))))))
), ended AS (SELECT lake, arg_max(root, n) AS root FROM walk GROUP BY lake)
SELECT id, ids[root[p]] AS zone FROM numbered JOIN ended USING (lake) JOIN lakes USING (lake)"""
)
def alg_zone_cluster(spark, d):
    """Zones of near places: links by length, merges refused by span, gap, density and stretch."""
    places = lake_places(spark, d)
    spots = places.drop("area_m2")
    pairs = within_radius(spots, spots, 480.0, 45.0, ("lake",)).filter("l_id < r_id")
    links = pairs.select(F.col("l_lake").alias("lake"), F.col("l_id").alias("i"), F.col("r_id").alias("j"), F.round("metres", 3).alias("metres"))
    return zones.guarded_zones(places.select("id", "lake", F.lit(1.0).alias("weight"), "area_m2", F.col("lon").alias("west"), F.col("lat").alias("south"), F.col("lon").alias("east"), F.col("lat").alias("north")), links, by="lake")


#: Trips start at the purchases of a lake, and its views are spots; places are metres on a grid.
PLAN = beam.Plan()
_TRIPS_SQL = """hashed AS (SELECT event_id AS id, event_id // 60 AS area, event_type AS kind, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS BIGINT) AS h FROM events),
places AS (SELECT id, area, kind, h % 100 * 25 AS x, h // 100 % 100 * 25 AS y, h FROM hashed),
trips AS (SELECT id AS trip, area, x, y, 21600 AS start, 21600 + 3600 * (1 + h % 4) AS "end", 300 AS reserve FROM places WHERE kind = 'purchase'),
options AS (SELECT id AS option, area, x, y, 100 + h % 900 AS worth, h // 900 % 3 - 1 AS likes FROM places WHERE kind = 'view')"""


#: The hours of a lake come from its clicks; the light of its spots counts for, against or not at all.
WEATHER = beam.Weather()
_HOURS_SQL = """hours AS (SELECT area, 21600 + 1800 * (h % 10) AS at, max(h // 10 % 450) AS wind, max(h // 5000 % 300) AS light FROM places WHERE kind = 'click' GROUP BY 1, 2),
forecasts AS (SELECT area, list({'hour': at, 'wind': wind, 'light': light} ORDER BY at) AS forecast FROM hours GROUP BY area)"""
_STOP_SQL = "STRUCT(option BIGINT, x BIGINT, y BIGINT, path VARCHAR, time BIGINT, used BIGINT, waited BIGINT, value BIGINT)[]"
_START_SQL = f"s0 AS (SELECT trip, [] :: {_STOP_SQL} AS stops, '' AS path, x, y, start AS time, 0 AS used, 0 AS waited, 0 AS value FROM trips)"
_BEST_SQL = "QUALIFY row_number() OVER (PARTITION BY trip ORDER BY value DESC, time, used, path)"


def _between_sql(time, field):
    """A forecast's field on the line between the hours around a time."""
    low, high = f"list_filter(forecast, lambda h: h.hour <= {time})[-1]", f"list_filter(forecast, lambda h: h.hour > {time})[1]"
    return f"CASE WHEN {low} IS NULL THEN {high}.{field} WHEN {high} IS NULL THEN {low}.{field} ELSE {low}.{field} + floor(({high}.{field} - {low}.{field}) * ({time} - {low}.hour) / ({high}.hour - {low}.hour)) END"


def _had_sql(plan, weather):
    """What a stop gives: by its dwell, or slot by slot under the forecast."""
    if weather is None:
        return f"worth * dwell // (dwell + {plan.half})"
    slots = []
    for i, share in enumerate(weather.shares(max(plan.dwells))):
        time = f"(arrive + {i * weather.slot})"
        blown = f"floor(({_between_sql(time, 'wind')} - {weather.soft_wind}) * 1000 / {weather.hard_wind - weather.soft_wind})"
        own = f"worth + likes * coalesce({_between_sql(time, 'light')}, 0) - coalesce(least(1000, greatest(0, {blown})), 0)"
        slots.append(f"CASE WHEN dwell > {i * weather.slot} THEN floor(least({weather.most}, greatest(0, {own})) * {share} / 1000) ELSE 0 END")
    return f"CAST({' + '.join(slots)} AS BIGINT)"


def _layer_sql(plan, name, before, weather=None):
    """A layer behind the states ``before``: every step with its reason, what is not dominated, and what the beam keeps."""
    metres = lambda x, y, u, v: f"CAST(round(sqrt(({x} - {u}) * ({x} - {u}) + ({y} - {v}) * ({y} - {v}))) AS BIGINT)"
    winds = ", ".join(_between_sql(t, "wind") for t in ("depart", "((depart + arrive) // 2)", "arrive")) if weather else ""
    return f"""e{name} AS (SELECT s.*, t."end", t.reserve, {"f.forecast, o.likes, " if weather else ""}o.option, o.x AS to_x, o.y AS to_y, worth, wait, dwell, {metres("s.x", "s.y", "o.x", "o.y")} AS leg, {metres("o.x", "o.y", "t.x", "t.y")} AS home
  FROM {before} s JOIN trips t USING (trip) JOIN options o ON o.area = t.area {"LEFT JOIN forecasts f ON f.area = t.area" if weather else ""}, (SELECT unnest({list(plan.waits)}) AS wait) w, (SELECT unnest({list(plan.dwells)}) AS dwell) d),
l{name} AS (SELECT *, time + wait AS depart, time + wait + leg // {plan.speed} AS arrive, time + wait + leg // {plan.speed} + dwell AS leave FROM e{name}),
r{name} AS (SELECT *, CASE WHEN len(list_filter(stops, lambda s: s.option = option)) > 0 THEN 'VISITED' WHEN waited + wait > {plan.max_wait} THEN 'WAITED_TOO_LONG'
  WHEN len(list_filter(stops, lambda s: {metres("s.x", "s.y", "to_x", "to_y")} < {plan.spacing})) > 0 THEN 'SPACING' WHEN leg > {plan.max_leg} THEN 'LEG_TOO_LONG' WHEN leave > "end" THEN 'AFTER_END'
  WHEN leave + home // {plan.speed} + reserve > "end" THEN 'RETURN_RESERVE' WHEN used + leg + home > {plan.max_range} THEN 'RANGE_EXCEEDED' {f"WHEN greatest({winds}) >= {weather.hard_wind} THEN 'WIND'" if weather else ""} END AS reason FROM l{name}),
g{name} AS (SELECT trip, stops, option, path || CASE WHEN path = '' THEN '' ELSE '>' END || option || ':' || wait || ':' || dwell AS path, to_x AS x, to_y AS y, leave AS time, used + leg AS used, waited + wait AS waited,
  value + {_had_sql(plan, weather)} - leg * {plan.leg_cost} // 100 - wait * {plan.wait_cost} // 60 AS value FROM r{name} WHERE reason IS NULL),
f{name} AS (SELECT trip, list_append(stops, {{'option': option, 'x': x, 'y': y, 'path': path, 'time': time, 'used': used, 'waited': waited, 'value': value}}) AS stops, path, x, y, time, used, waited, value, option AS last_option FROM g{name}),
k{name} AS (SELECT *, list_sort(list_transform(stops, lambda s: s.option)) AS among FROM f{name}),
d{name} AS (SELECT b.* FROM k{name} b WHERE NOT EXISTS (SELECT 1 FROM k{name} a WHERE a.trip = b.trip AND a.among = b.among AND a.last_option = b.last_option AND a.time <= b.time AND a.used <= b.used AND a.value >= b.value AND (a.time < b.time OR a.used < b.used OR a.value > b.value))),
s{name} AS (SELECT trip, stops, path, x, y, time, used, waited, value FROM d{name} {_BEST_SQL} <= {plan.width})"""


def _layers_sql(plan, weather=None):
    """The layers one after another."""
    parts = [_TRIPS_SQL, *([_HOURS_SQL] if weather else []), _START_SQL]
    return "WITH " + ",\n".join(parts + [_layer_sql(plan, i, f"s{i - 1}", weather) for i in range(1, plan.max_stops + 1)])


def _rolling_sql(plan, ahead):
    """Windows of ``ahead`` layers, each behind the first stop of the best of the last one."""
    parts, settled = [_TRIPS_SQL, _START_SQL], "s0"
    for i in range(plan.max_stops):
        names = [f"{i}_{depth}" for depth in range(min(ahead, plan.max_stops - i))]
        parts += [_layer_sql(plan, name, before) for name, before in zip(names, [settled, *(f"s{n}" for n in names)])]
        window = " UNION ALL ".join(f"SELECT * FROM s{name}" for name in names)
        parts.append(f"w{i} AS (SELECT trip, stops[:{i + 1}] AS stops, stops[{i + 1}] AS z FROM ({window}) {_BEST_SQL} = 1)")
        parts.append(f"c{i} AS (SELECT trip, stops, z.path AS path, z.x AS x, z.y AS y, z.time AS time, z.used AS used, z.waited AS waited, z.value AS value FROM w{i})")
        settled = f"c{i}"
    return "WITH " + ",\n".join(parts)


def _routes_sql(states):
    """The best of the states of each trip."""
    return f"""best AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM {s}" for s in states)}) {_BEST_SQL} = 1)
SELECT t.trip, path, CAST(coalesce(len(stops), 0) AS BIGINT) AS stops, CAST(time AS BIGINT) AS time, CAST(used AS BIGINT) AS used, CAST(value AS BIGINT) AS value FROM trips t LEFT JOIN best USING (trip)"""


def _places(spark, d):
    """(id, area, kind, x, y, h) of every event, in metres."""
    h = F.conv(F.substr(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(1), F.lit(6)), 16, 10).cast("long")
    p = table(spark, d, "events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 60).alias("area"), F.col("event_type").alias("kind"), h.alias("h"))
    return p.select("id", "area", "kind", (F.col("h") % 100 * 25).alias("x"), (F.floor(F.col("h") / 100) % 100 * 25).alias("y"), "h")


def _trips(p):
    start = F.lit(21_600).cast("long")
    return p.filter("kind = 'purchase'").select(F.col("id").alias("trip"), "area", "x", "y", start.alias("start"), (start + 3600 * (1 + F.col("h") % 4)).alias("end"), F.lit(300).alias("reserve"))


def _options(p):
    return p.filter("kind = 'view'").select(F.col("id").alias("option"), "area", "x", "y", (F.col("h") % 900 + 100).alias("worth"), (F.floor(F.col("h") / 900) % 3 - 1).alias("likes"))


def _search(spark, d):
    p = _places(spark, d)
    return beam.search(_trips(p), _options(p), PLAN)


_LAYERS = range(1, PLAN.max_stops + 1)


@query(f"{_layers_sql(PLAN)}, {_routes_sql([f's{i}' for i in _LAYERS])}")
def alg_beam_route(spark, d):
    """The best route of each trip out of all layers."""
    return _search(spark, d).routes


@query(
    _layers_sql(PLAN) + " " + " UNION ALL ".join(f"SELECT trip, {i} AS layer, reached, \"left\", kept FROM (SELECT trip, count(*) AS reached FROM f{i} GROUP BY 1) JOIN (SELECT trip, count(*) AS \"left\" FROM d{i} GROUP BY 1) USING (trip) JOIN (SELECT trip, count(*) AS kept FROM s{i} GROUP BY 1) USING (trip)" for i in _LAYERS)
)
def alg_beam_layers(spark, d):
    """States that each layer reaches, that are not dominated, and that the beam keeps."""
    return _search(spark, d).layers


@query(_layers_sql(PLAN) + " " + " UNION ALL ".join(f"SELECT trip, {i} AS layer, reason, count(*) AS n FROM r{i} WHERE reason IS NOT NULL GROUP BY trip, reason" for i in _LAYERS))
def alg_beam_expand(spark, d):
    """Refused steps by layer and reason."""
    return _search(spark, d).rejects


@query(f"{_layers_sql(PLAN, WEATHER)}, {_routes_sql([f's{i}' for i in _LAYERS])}")
def alg_beam_weather(spark, d):
    """Routes under forecasts: worth by light and wind in each slot of a stop, and no way under hard wind."""
    p = _places(spark, d)
    at = (21_600 + 1800 * (F.col("h") % 10)).alias("at")
    hours = p.filter("kind = 'click'").groupBy("area", at).agg(F.max(F.floor(F.col("h") / 10) % 450).alias("wind"), F.max(F.floor(F.col("h") / 5000) % 300).alias("light"))
    return beam.search(_trips(p), _options(p), PLAN, hours, WEATHER).routes


AHEAD = 2


@query(f"{_rolling_sql(PLAN, AHEAD)}, {_routes_sql([f'c{i}' for i in range(PLAN.max_stops)])}")
def alg_beam_rolling(spark, d):
    """Routes settled a stop at a time, each by a look over a window of layers."""
    p = _places(spark, d)
    return beam.rolling(_trips(p), _options(p), PLAN, AHEAD)


VISIT = subplans.Visit(pace=200)
_HOP = "CAST(round(sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))) AS BIGINT)"


@query(
    f"""WITH RECURSIVE {_TRIPS_SQL}, members AS (SELECT area AS zone, option AS member, x, y, worth, row_number() OVER (PARTITION BY area ORDER BY worth DESC, option) AS place FROM options),
zones AS (SELECT area AS zone, arg_min(x, id) AS in_x, arg_min(y, id) AS in_y, arg_max(x, id) AS out_x, arg_max(y, id) AS out_y FROM places WHERE area IN (SELECT zone FROM members) GROUP BY area),
walk AS (
  SELECT zone, budget, 1 AS step, in_x AS x, in_y AS y, budget AS rest, 0 :: BIGINT AS fishing, 0 :: BIGINT AS transit, 0 :: BIGINT AS metres, 0 :: BIGINT AS utility, [] :: BIGINT[] AS stops
  FROM zones, (SELECT CAST(unnest({list(VISIT.budgets)}) AS BIGINT) AS budget)
  UNION ALL
  SELECT zone, budget, step + 1, to_x, to_y, rest - hop - dwell, fishing + dwell, transit + hop, metres + way, utility + greatest(0, score), list_append(stops, member) FROM (
    SELECT *, worth * dwell // {VISIT.longest} - {VISIT.hop_cost} * hop AS score FROM (
      SELECT *, least({VISIT.longest}, rest - hop) AS dwell FROM (
        SELECT *, greatest(1, CAST(round(way / {VISIT.pace}) AS BIGINT)) AS hop FROM (
          SELECT w.*, m.member, m.x AS to_x, m.y AS to_y, m.worth, m.place, {_HOP.format(a="w", b="m")} AS way FROM walk w JOIN members m USING (zone) WHERE NOT list_contains(w.stops, m.member))))
    WHERE dwell >= {VISIT.shortest}
    QUALIFY row_number() OVER (PARTITION BY zone, budget ORDER BY score DESC, place) = 1)
), ended AS (
  SELECT w.*, CAST(round(sqrt((x - out_x) * (x - out_x) + (y - out_y) * (y - out_y))) AS BIGINT) AS way FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY zone, budget ORDER BY step DESC) = 1) w JOIN zones USING (zone)
), made AS (
  SELECT zone, budget, stops, fishing, transit + CAST(round(way / {VISIT.pace}) AS BIGINT) AS transit, metres + way AS metres, utility FROM ended WHERE CAST(round(way / {VISIT.pace}) AS BIGINT) <= rest AND fishing > 0
)
SELECT zone, budget, array_to_string(stops, '>') AS stops, fishing, transit, metres, utility FROM made b
WHERE NOT EXISTS (SELECT 1 FROM made a WHERE a.zone = b.zone AND a.budget <= b.budget AND a.utility >= b.utility AND (a.budget < b.budget OR a.utility > b.utility))"""
)
def alg_subzone_plan(spark, d):
    """What each budget of minutes buys inside a zone, greedily, with time left for the way out."""
    p = _places(spark, d)
    member = F.struct((-F.col("worth")).alias("first"), F.col("id").alias("member"), "x", "y", "worth")
    views = p.filter("kind = 'view'").withColumn("worth", F.col("h") % 900 + 100).groupBy("area").agg(F.array_sort(F.collect_list(member)).alias("members"))
    ends = p.groupBy("area").agg(F.min_by(F.struct("x", "y"), "id").alias("entry"), F.max_by(F.struct("x", "y"), "id").alias("exit"))
    made = subplans.packages(views.join(ends, "area").withColumnRenamed("area", "zone"), VISIT)
    return made.withColumn("stops", F.array_join(F.transform("stops", lambda s: s.cast("string")), ">"))
