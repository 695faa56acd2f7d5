"""Queries of sources, sinks and scalar functions of dates, texts, arrays and documents."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import geo, scores
from driftline.operators.lineage import checkpoint_folder, checkpointed
from driftline.operators.relational import insert_ignore
from driftline.plans.base import POINTS, epoch, points, query, table
from driftline.plans.places import geo_raster
from driftline.sources import readers, sinks

# --- sources


def _micro(c):
    return F.round(F.col(c) * 1_000_000).cast("long")


def _documents(rows, *keys):
    """Feature collections of rows (point_id, lon, lat, kind), with positions in millionths of a degree."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(_micro("lon"), _micro("lat")).alias("coordinates"))
    return sinks.feature_collection(rows, list(keys), "point_id", geometry, F.struct(F.col("point_id").cast("string").alias("id"), F.col("kind").alias("kind")))


@query(f"WITH {POINTS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY point_id) - 1 AS feature_no, 'Point' AS geometry_type, CAST(round(lon * 1000000) AS BIGINT) AS x, CAST(round(lat * 1000000) AS BIGINT) AS y, CAST(point_id AS VARCHAR) AS id, kind FROM points")
def src_geojson(spark, d):
    """Features of documents that hold them nested."""
    read = readers.geojson_features(_documents(points(spark, d), "session_id"))
    at = F.from_json("coordinates", "array<bigint>")
    return read.select("session_id", F.col("feature_no").cast("long").alias("feature_no"), "geometry_type", at[0].alias("x"), at[1].alias("y"), F.col("properties")["id"].alias("id"), F.col("properties")["kind"].alias("kind"))


@query(f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY point_id) - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM points) SELECT session_id, CAST(rn // 10 * 10 AS BIGINT) AS page_offset, count(*) AS features, n >= 40 AS capped FROM r WHERE rn < 40 GROUP BY ALL")
def src_arcgis_paged(spark, d):
    """Pages of ten features up to the first that ends its source, four at most; what comes after an end is not read."""
    w = Window.partitionBy("session_id").orderBy("point_id")
    r = points(spark, d).withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("session_id"))})
    r = r.withColumn("page_offset", (F.floor(F.col("rn") / 10) * 10).cast("long"))
    more = r.groupBy("session_id", "page_offset").agg((F.max("n") > F.col("page_offset") + 10).alias("more"), F.count("*").alias("n"))
    pages = _documents(r, "session_id", "page_offset").join(more, ["session_id", "page_offset"])
    closed = lambda content, flag: F.concat(F.expr("substr(content, 1, length(content) - 1)") if content is None else F.lit(content), F.lit(',"exceededTransferLimit":'), flag, F.lit("}"))
    # Behind a full last page comes an empty one; behind a short one a stray page, as a source that ignores offsets gives it.
    full = (F.col("n") == 10) & ~F.col("more")
    behind = pages.filter("NOT more").select("session_id", (F.col("page_offset") + 10).alias("page_offset"), F.when(full, closed('{"features":[]', F.lit("false"))).otherwise(closed(None, F.lit("false"))).alias("content"))
    pages = pages.select("session_id", "page_offset", closed(None, F.col("more").cast("string")).alias("content")).unionByName(behind)
    read = readers.paged_features(pages, "session_id", "page_offset", 10, 4)
    return read.groupBy("session_id", "page_offset", "capped").agg(F.count("*").alias("features"))


@query("SELECT page_id, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages WHERE html IS NOT NULL")
def src_regulation_doc(spark, d):
    """Documents stored one file each and read as bytes, with their checksums."""
    folder = f"{checkpoint_folder(spark)}/documents-{uuid.uuid4().hex}"
    pages = table(spark, d, "pages").filter("html IS NOT NULL").select("page_id", "html")
    sinks.write_documents(pages, "page_id", "html", folder)
    read = readers.stored_documents(spark, folder)
    return read.select(F.col("key").cast("long").alias("page_id"), F.col("length").alias("bytes"), "sha256")


@query(f"WITH {POINTS} SELECT point_id, kind FROM points WHERE lon BETWEEN -78.97 AND -78.93 AND lat BETWEEN 44.02 AND 44.06")
def src_intersecting(spark, d):
    """Rows in a box; a plain range on both axes, which a scan of stored positions can push down."""
    return points(spark, d).filter(geo.in_box("lon", "lat", -78.97, 44.02, -78.93, 44.06)).select("point_id", "kind")


@query(f"WITH {POINTS} SELECT session_id, CAST(at AS VARCHAR) AS time, round(value, 6) AS wind, k % 20 :: DOUBLE AS rain FROM points WHERE kind = 'view'")
def src_weather_hourly(spark, d):
    """Hours of documents with parallel arrays."""
    views = points(spark, d).filter("kind = 'view'")
    rows = F.sort_array(F.collect_list(F.struct("at", "point_id", "value", (F.col("k") % 20).cast("double").alias("rain"))))
    docs = views.groupBy("session_id").agg(rows.alias("r"))
    of = lambda f: F.transform("r", f)
    docs = docs.select("session_id", F.to_json(F.struct(F.struct(of(lambda x: x["at"].cast("string")).alias("time"), of(lambda x: x["value"]).alias("wind"), of(lambda x: x["rain"]).alias("rain")).alias("hourly"))).alias("content"))
    return readers.hourly_weather(docs, "content", ["wind", "rain"]).select("session_id", "time", F.round("wind", 6).alias("wind"), "rain")


@query("SELECT item_id AS case_id, item_id % 3 = 0 AS simulated, length(text) AS prompt_chars FROM benchmark")
def src_fixture_catalog(spark, d):
    """Evaluation cases of JSON documents by a fixed schema."""
    b = table(spark, d, "benchmark")
    docs = b.select(F.to_json(F.struct(F.col("item_id").alias("caseId"), F.struct((F.col("item_id") % 3 == 0).alias("simulated")).alias("flags"), F.col("text").alias("prompt"))).alias("content"))
    case = docs.select(F.from_json("content", "caseId long, flags struct<simulated: boolean>, prompt string").alias("c"))
    return case.select(F.col("c.caseId").alias("case_id"), "c.flags.simulated", F.length("c.prompt").cast("long").alias("prompt_chars"))


@query(f"WITH {POINTS}, b AS (SELECT session_id, at // 86400 AS batch, count(*) AS n FROM points GROUP BY 1, 2) SELECT session_id, batch, n, CASE WHEN n <= 3 THEN 'ACCEPTED' ELSE 'TOO_LARGE' END AS verdict FROM b")
def src_gps_batch(spark, d):
    """Client batches; one of more points than allowed is refused whole."""
    b = points(spark, d).groupBy("session_id", F.floor(F.col("at") / 86_400).alias("batch")).agg(F.count("*").alias("n"))
    return b.withColumn("verdict", F.when(F.col("n") <= 3, "ACCEPTED").otherwise("TOO_LARGE"))


def _raster_sql():
    from driftline.plans.base import SQL

    return SQL["geo_raster"]


@query(_raster_sql())
def src_raster_tiles(spark, d):
    """Raster rows packed to bits and read again."""
    return readers.unpack_rows(readers.pack_rows(geo_raster(spark, d), ["session_id", "row"], "col", "water"), ["session_id", "row"], "col", "water")


# --- sinks


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS type, l_partkey % 3 AS lake, 'OLD' AS source FROM lineitem), n AS (SELECT o_orderkey * 10 AS id, o_orderkey % 3 AS type, o_custkey % 2 AS lake, 'NEW' AS source FROM orders), k AS (SELECT DISTINCT type, lake FROM n)
SELECT * FROM t WHERE id % 11 = 0 OR NOT EXISTS (SELECT 1 FROM k WHERE k.type = t.type AND k.lake = t.lake) UNION ALL SELECT * FROM n""")
def snk_replace_partition(spark, d):
    """The rows of a lake and type give way to new ones; those that a plan refers to stay."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    t = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").cast("long").alias("type"), (F.col("l_partkey") % 3).cast("long").alias("lake"), F.lit("OLD").alias("source"))
    n = o.select((F.col("o_orderkey") * 10).alias("id"), (F.col("o_orderkey") % 3).cast("long").alias("type"), (F.col("o_custkey") % 2).cast("long").alias("lake"), F.lit("NEW").alias("source"))
    return sinks.replaced(t, n, ["type", "lake"], "id", t.filter("id % 11 = 0"))


@query(f"WITH {POINTS}, u AS (SELECT session_id, arg_max(k, at * 10000000 + point_id) AS k, count(*) AS n FROM points WHERE kind = 'click' GROUP BY 1), t AS (SELECT session_id, count(*) AS n FROM points GROUP BY 1) SELECT t.session_id, CASE WHEN u.n IS NULL THEN '{{}}' ELSE '{{\"last\":' || k || '}}' END AS usage, CASE WHEN u.n IS NULL THEN '{{\"n\":' || t.n || '}}' ELSE '{{\"n\":' || t.n || ',\"clicks\":' || u.n || '}}' END AS cost FROM t LEFT JOIN u ON u.session_id = t.session_id")
def snk_update_json(spark, d):
    """Two document columns of the rows that have an update; the others keep theirs."""
    p = points(spark, d)
    u = p.filter("kind = 'click'").groupBy("session_id").agg(F.max_by("k", F.struct("at", "point_id")).alias("last"), F.count("*").alias("clicks"))
    t = p.groupBy("session_id").agg(F.count("*").alias("n"))
    return t.join(u, "session_id", "left").select("session_id", F.to_json(F.struct("last")).alias("usage"), F.to_json(F.struct("n", "clicks")).alias("cost"))


@query("SELECT count(*) AS n, count(DISTINCT s_suppkey) AS ids FROM supplier")
def snk_batch_insert(spark, d):
    """A whole batch, written and read as one table."""
    kept = checkpointed(table(spark, d, "supplier").select("s_suppkey", "s_name"))
    return kept.agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("ids"))


@query(f"""WITH {POINTS} SELECT session_id, '{{"type":"FeatureCollection","features":[' || string_agg('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(round(lon * 1000000) AS BIGINT) || ',' || CAST(round(lat * 1000000) AS BIGINT) || ']}},"properties":{{"id":"' || point_id || '","kind":"' || kind || '"}}}}', ',' ORDER BY point_id) || ']}}' AS content FROM points GROUP BY 1""")
def snk_geojson(spark, d):
    return _documents(points(spark, d), "session_id")


@query(f"WITH {POINTS}, known AS (SELECT session_id, k AS key, min(point_id) AS point_id FROM points WHERE kind = 'view' GROUP BY 1, 2), fresh AS (SELECT session_id, k AS key, min(point_id) AS point_id FROM points WHERE kind <> 'view' GROUP BY 1, 2) SELECT * FROM known UNION ALL SELECT * FROM fresh ANTI JOIN known USING (session_id, key)")
def snk_event_append(spark, d):
    """Events appended once for each session and key, whatever comes again."""
    p = points(spark, d).select("session_id", F.col("k").alias("key"), "point_id", "kind")
    known = p.filter("kind = 'view'").groupBy("session_id", "key").agg(F.min("point_id").alias("point_id"))
    return insert_ignore(known, p.filter("kind <> 'view'").select("session_id", "key", "point_id"), ["session_id", "key"], [F.asc("point_id")])


@query("SELECT event_id, trim(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END) AS name FROM events WHERE trim(CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END) <> ''")
def snk_analytics_event(spark, d):
    name = F.trim(F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))))
    return table(spark, d, "events").select("event_id", name.alias("name")).filter("name <> ''")


# --- dates


@query("""WITH q AS (SELECT o_orderkey, o_orderkey % 86400 AS starts, o_custkey * 37 % 86400 AS ends, epoch_us(o_orderdate :: TIMESTAMP) // 1000000 AS day, o_orderkey % 3 + 4 AS west FROM orders)
SELECT o_orderkey, day + starts + west * 3600 AS start_at, day + ends + CASE WHEN ends <= starts THEN 86400 ELSE 0 END + west * 3600 AS end_at, ends <= starts AS overnight, ends + CASE WHEN ends <= starts THEN 86400 ELSE 0 END - starts <= 86400 AS within_day FROM q""")
def fn_trip_clock(spark, d):
    """Start and end of a trip by its lake's clock; an end at or before the start is on the next day."""
    key = F.col("o_orderkey")
    q = table(spark, d, "orders").select("o_orderkey", (key % 86_400).alias("starts"), (F.col("o_custkey") * 37 % 86_400).alias("ends"), epoch(F.col("o_orderdate").cast("timestamp_ntz")).alias("day"), F.concat(F.lit("-0"), (key % 3 + 4).cast("string"), F.lit(":00")).alias("zone"))
    overnight = F.col("ends") <= F.col("starts")
    seconds = F.col("ends") + F.when(overnight, 86_400).otherwise(0)
    instant = lambda s: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.col("day") + s), F.col("zone")))
    return q.select("o_orderkey", instant(F.col("starts")).alias("start_at"), instant(seconds).alias("end_at"), overnight.alias("overnight"), (seconds - F.col("starts") <= 86_400).alias("within_day"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_custkey % 24 <= o_orderkey % 24 THEN 1 ELSE 0 END :: INT AS end_date FROM orders")
def fn_end_date(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 24 <= F.col("o_orderkey") % 24, F.date_add(day, 1)).otherwise(day).alias("end_date"))


@query(f"WITH {POINTS} SELECT point_id, CASE WHEN at // 3600 % 24 >= 6 AND at // 3600 % 24 < 10 THEN 'MORNING' WHEN at // 3600 % 24 >= 9 AND at // 3600 % 24 < 17 THEN 'DAY' WHEN at // 3600 % 24 >= 17 AND at // 3600 % 24 < 22 THEN 'EVENING' END AS matched FROM points")
def fn_time_window(spark, d):
    """The first window [from, to) that holds a local hour; windows don't run over midnight."""
    windows = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(n).alias("name")) for a, b, n in ((6, 10, "MORNING"), (9, 17, "DAY"), (17, 22, "EVENING"), (22, 4, "NIGHT"))])
    hour = F.floor(F.col("at") / 3600) % 24
    return points(spark, d).select("point_id", F.try_element_at(F.filter(windows, lambda w: (hour >= w["from"]) & (hour < w["to"])), F.lit(1))["name"].alias("matched"))


@query(f"WITH {POINTS}, h AS (SELECT session_id, point_id, at, at // 3600 % 24 AS hour FROM points), w AS (SELECT *, CASE WHEN hour < lag(hour) OVER o THEN 1 ELSE 0 END AS wrapped FROM h WINDOW o AS (PARTITION BY session_id ORDER BY at, point_id)) SELECT session_id, point_id, CAST(sum(wrapped) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day FROM w")
def fn_rolling_date(spark, d):
    """Days since the first hour, one more each time the clock goes backwards."""
    w = Window.partitionBy("session_id").orderBy("at", "point_id")
    h = points(spark, d).withColumn("hour", F.floor(F.col("at") / 3600) % 24)
    wrapped = F.when(F.col("hour") < F.lag("hour").over(w), 1).otherwise(0)
    return h.withColumn("wrapped", wrapped).select("session_id", "point_id", F.sum("wrapped").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("day"))


# --- numbers


@query(f"WITH {POINTS}, q AS (SELECT point_id, k * 7.2 AS a, value * 5 AS b FROM points), t AS (SELECT *, fmod(fmod(b - a, 360) + 360, 360) AS turn FROM q) SELECT point_id, round(CASE WHEN turn > 180 THEN turn - 360 ELSE turn END, 6) AS delta, round(fmod(fmod(a + CASE WHEN turn > 180 THEN turn - 360 ELSE turn END * 0.25, 360) + 360, 360), 6) AS quarter FROM t")
def fn_circular(spark, d):
    """The turn between two bearings, and a quarter of it taken."""
    # 7.2 is a decimal in SQL: the product is exact, and rounded once when it meets a double.
    a, b = (F.col("k") * F.lit(Decimal("7.2"))).cast("double"), F.col("value") * 5
    delta = geo.signed_delta(a, b)
    return points(spark, d).select("point_id", F.round(delta, 6).alias("delta"), F.round(geo.full_circle(a + delta * 0.25), 6).alias("quarter"))


_DECL = "radians(23.44 * sin(2 * pi() * (day - 81) / 365.0))"


@query(f"WITH {POINTS}, q AS (SELECT point_id, radians(lat) AS phi, at // 86400 - 19723 + 1 AS day, (at % 86400) / 3600.0 + lon / 15.0 AS solar FROM points), e AS (SELECT point_id, phi, {_DECL} AS dec, radians(15 * (solar - 12)) AS h FROM q) SELECT point_id, round(degrees(asin(sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(h))), 4) AS elevation FROM e")
def fn_sun_elevation(spark, d):
    """The sun's height by declination and hour angle (mean sun)."""
    return points(spark, d).select("point_id", F.round(scores.sun_elevation(F.col("at") / 86_400, F.col("at") % 86_400 / F.lit(3600.0), "lon", "lat"), 4).alias("elevation"))


# --- texts


@query(f"WITH {POINTS} SELECT point_id, CASE kind WHEN 'click' THEN 'Bite recorded' WHEN 'error' THEN 'Fish on' WHEN 'purchase' THEN 'Catch recorded' WHEN 'signup' THEN 'Moved to waypoint ' || CASE WHEN k % 3 > 0 THEN CAST(k AS VARCHAR) ELSE 'current' END END AS clip FROM points")
def fn_fact_clips(spark, d):
    """A sentence for an event; events that say nothing have none."""
    kind = F.col("kind")
    where = F.coalesce(F.when(F.col("k") % 3 > 0, F.col("k").cast("string")), F.lit("current"))
    clip = F.when(kind == "click", "Bite recorded").when(kind == "error", "Fish on").when(kind == "purchase", "Catch recorded").when(kind == "signup", F.concat(F.lit("Moved to waypoint "), where))
    return points(spark, d).select("point_id", clip.alias("clip"))


@query(f"WITH {POINTS}, s AS (SELECT session_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS text FROM (SELECT session_id, kind, count(*) AS n FROM points GROUP BY 1, 2) GROUP BY 1) SELECT session_id, sha256(text) AS fingerprint FROM s")
def fn_source_fingerprint(spark, d):
    """A checksum of counts by sorted key, the same in whatever order they came."""
    n = points(spark, d).groupBy("session_id", "kind").agg(F.count("*").alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit("="), x["n"].cast("string")))
    return n.groupBy("session_id").agg(F.sha2(F.array_join(parts, ","), 256).alias("fingerprint"))


@query(f"WITH {POINTS} SELECT point_id, sha256(concat_ws('|', session_id, kind, coalesce(CAST(CASE WHEN k % 2 = 0 THEN k END AS VARCHAR), 'null'))) AS digest FROM points")
def fn_canonical_sha256(spark, d):
    return points(spark, d).select("point_id", scores.canonical_sha256("session_id", "kind", F.when(F.col("k") % 2 == 0, F.col("k"))).alias("digest"))


@query("WITH m AS (SELECT event_id, md5('no-bite:' || event_id) AS m FROM events) SELECT event_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr(m, 17, 1)) - 1) % 4 + 1] || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS id FROM m")
def fn_uuid3(spark, d):
    return table(spark, d, "events").select("event_id", scores.uuid3(F.concat(F.lit("no-bite:"), F.col("event_id").cast("string"))).alias("id"))


@query("SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) NOT IN ('STANDARD', 'ECONOMY') THEN 'OTHER' ELSE split_part(p_type, ' ', 1) END AS kind FROM part")
def fn_whitelist(spark, d):
    kind = F.split("p_type", " ")[0]
    return table(spark, d, "part").select("p_partkey", F.when(~kind.isin("STANDARD", "ECONOMY"), "OTHER").otherwise(kind).alias("kind"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 2 = 0 THEN p_partkey % 50 END, 7) AS filled FROM part")
def fn_backfill(spark, d):
    size = F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(size % 3 == 0, size), F.when(size % 2 == 0, F.col("p_partkey") % 50), F.lit(7)).alias("filled"))


# --- arrays and documents


@query(f"WITH {POINTS}, a AS (SELECT session_id, list(k ORDER BY at, point_id) AS ks FROM points GROUP BY 1) SELECT session_id, array_to_string(ks[1:3], ',') AS first_three, len(list_distinct(ks)) AS different, list_contains(ks, 7) AS has_seven, len(list_filter(ks, lambda x: x > 95)) > 0 AS any_large FROM a")
def fn_arrays(spark, d):
    """First values, distinct ones, membership and a test of any."""
    ks = F.transform(F.sort_array(F.collect_list(F.struct("at", "point_id", "k"))), lambda x: x["k"])
    a = points(spark, d).groupBy("session_id").agg(ks.alias("ks"))
    return a.select("session_id", F.array_join(F.transform(F.slice("ks", 1, 3), lambda x: x.cast("string")), ",").alias("first_three"), F.size(F.array_distinct("ks")).cast("long").alias("different"), F.array_contains("ks", 7).alias("has_seven"), F.exists("ks", lambda x: x > 95).alias("any_large"))


_KINDS = ("click", "view", "purchase", "error")


@query(f"WITH {POINTS} SELECT session_id, kind AS type, bool_or(value > 30) AS available FROM points WHERE kind <> 'signup' GROUP BY 1, 2")
def fn_availability(spark, d):
    """A nested list of availabilities as a map; unknown names in it are left out."""
    s = points(spark, d).groupBy("session_id", "kind").agg(F.bool_or(F.col("value") > 30).alias("available"))
    docs = s.groupBy("session_id").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("kind").alias("type"), "available")).alias("structure")).alias("lake"))).alias("doc"))
    rows = F.from_json("doc", "lake struct<structure: array<struct<type: string, available: boolean>>>")["lake"]["structure"]
    known = F.filter(rows, lambda r: r["type"].isin(*_KINDS) & r["available"].isNotNull())
    as_map = F.map_from_entries(F.transform(known, lambda r: F.struct(r["type"], r["available"])))
    return docs.select("session_id", F.explode(as_map).alias("type", "available"))


_CODES = "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN [] :: VARCHAR[] ELSE [['GAS', 'ELECTRIC', 'PADDLE'][p_size % 3 + 1], 'OARS'] END"


def _codes():
    size = F.col("p_size")
    pick = F.element_at(F.array(*map(F.lit, ("GAS", "ELECTRIC", "PADDLE"))), (size % 3 + 1).cast("int"))
    return F.when(size % 5 == 1, F.array().cast("array<string>")).when(size % 5 > 1, F.array(pick, F.lit("OARS")))


@query(f"WITH q AS (SELECT p_partkey, {_CODES} AS codes FROM part) SELECT p_partkey, array_to_string(coalesce(list_transform(codes, lambda c: CASE c WHEN 'GAS' THEN 'GASOLINE' WHEN 'OARS' THEN 'PADDLE' ELSE c END), []), ',') AS remapped FROM q")
def fn_remap_codes(spark, d):
    """Each code of an array by a rule; null and empty arrays are empty."""
    remapped = F.coalesce(F.transform(_codes(), lambda c: F.when(c == "GAS", "GASOLINE").when(c == "OARS", "PADDLE").otherwise(c)), F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", F.array_join(remapped, ",").alias("remapped"))


@query(f"WITH q AS (SELECT p_partkey, {_CODES} AS codes FROM part) SELECT p_partkey, coalesce(list_contains(codes, 'ELECTRIC'), false) AS electric, coalesce(codes[1], 'NONE') AS first_code, coalesce(len(codes), 0) AS n FROM q")
def fn_code_checks(spark, d):
    codes = _codes()
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.array_contains(codes, "ELECTRIC"), F.lit(False)).alias("electric"), F.coalesce(F.try_element_at(codes, F.lit(1)), F.lit("NONE")).alias("first_code"), F.coalesce(F.when(codes.isNotNull(), F.size(codes)), F.lit(0)).cast("long").alias("n"))


@query(f"WITH q AS (SELECT p_partkey, {_CODES} AS codes FROM part) SELECT p_partkey, '[' || array_to_string(list_transform(coalesce(codes, []), lambda c: '{{\"type\":\"' || c || '\",\"primary\":' || (c = codes[1]) || '}}'), ',') || ']' AS motors FROM q")
def fn_build_objects(spark, d):
    """A document of one object for each code, the first marked."""
    codes = _codes()
    objects = F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: F.struct(c.alias("type"), (c == codes[0]).alias("primary")))
    return table(spark, d, "part").select("p_partkey", F.to_json(objects).alias("motors"))


@query("SELECT doc_id, coalesce(length(text), 0) AS chars FROM documents WHERE false UNION ALL SELECT event_id, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def fn_payload_value(spark, d):
    """A number of a document, where it is one."""
    return table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.get_json_object("props", "$.k").try_cast("bigint").alias("chars")).filter("chars IS NOT NULL")


@query(f"""WITH {POINTS} SELECT point_id, CASE WHEN k % 4 = 0 THEN NULL ELSE k % 3 END AS n_features FROM points""")
def alg_vision_parse(spark, d):
    """Features of the outermost braces of an answer; text around them is left out, an answer without them gives none."""
    k = F.col("k")
    feature = F.concat(F.lit('{"type":"HUMP","box":['), k.cast("string"), F.lit("]}"))
    body = F.concat(F.lit('{"features":['), F.array_join(F.array_repeat(feature, (k % 3).cast("int")), ","), F.lit("]}"))
    answers = points(spark, d).select("point_id", F.when(k % 4 == 0, "no structure seen").otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))).alias("answer"))
    outer = F.nullif(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.from_json(outer, "features array<struct<type: string, box: array<bigint>>>")["features"]
    known = F.filter(found, lambda f: (f["type"] == "HUMP") & (F.size(f["box"]) == 1))
    return answers.select("point_id", F.when(found.isNotNull(), F.size(known)).cast("long").alias("n_features"))


# --- late data, sessions by gap


@query(f"WITH {POINTS}, late AS (SELECT DISTINCT session_id FROM points WHERE kind = 'purchase' AND k > 90), t AS (SELECT session_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM points GROUP BY 1), o AS (SELECT session_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM points WHERE NOT (kind = 'purchase' AND k > 90) GROUP BY 1) SELECT session_id, n, total, session_id IN (SELECT session_id FROM late) AS recomputed FROM t")
def stm_late_data(spark, d):
    """Late catches are taken, and the sessions that they belong to are computed again; the others keep their result."""
    p = points(spark, d)
    is_late = (F.col("kind") == "purchase") & (F.col("k") > 90)
    sums = lambda rows: rows.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
    touched = p.filter(is_late).select("session_id").distinct()
    again = sums(p.join(touched, "session_id", "left_semi")).withColumn("recomputed", F.lit(True))
    before = sums(p.filter(~is_late)).join(touched, "session_id", "left_anti").withColumn("recomputed", F.lit(False))
    return again.unionByName(before)


@query(f"WITH {POINTS}, m AS (SELECT *, CASE WHEN at - lag(at) OVER w >= 43200 OR lag(at) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM points WINDOW w AS (PARTITION BY session_id ORDER BY at, point_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY at, point_id ROWS UNBOUNDED PRECEDING) AS part FROM m) SELECT session_id, min(at) AS started, max(at) + 43200 AS closed, count(*) AS n FROM s GROUP BY session_id, part")
def stm_session_window(spark, d):
    """Sessions by gap, which the reference does not have (an extension): Spark's own windows."""
    p = points(spark, d).withColumn("ts", F.timestamp_seconds("at"))
    # Spark's windows merge where they only touch; times are whole seconds, so half a second less keeps a gap of just twelve hours apart.
    w = p.groupBy("session_id", F.session_window("ts", "43199 seconds 500 milliseconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select("session_id", F.unix_seconds("w.start").alias("started"), (F.unix_seconds("w.end") + 1).alias("closed"), "n")
