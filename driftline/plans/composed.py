"""Queries that combine the operators in one more way: cascades, matches, merges, plans and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import temporal as T
from driftline.plans.base import POINTS, points, query, rounded, table


def _order():
    return F.struct("at", "point_id")


def _of_kind(p: DataFrame, kind: str) -> DataFrame:
    return p.filter(F.col("kind") == kind)


# --- joins


@query("WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_returnflag <> 'N') SELECT o_orderkey, l_linenumber AS run FROM orders LEFT JOIN r ON o_orderkey = l_orderkey AND rn = 1")
def join_fk_not_time(spark, d):
    """Each trigger with its latest run by key alone; runs on trial are left out before the choice."""
    runs = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct("l_shipdate", "l_linenumber")).alias("latest"))
    return table(spark, d, "orders").select("o_orderkey").join(runs, "o_orderkey", "left").select("o_orderkey", F.col("latest.l_linenumber").alias("run"))


@query("SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, round(abs(a.p_retailprice - b.p_retailprice), 2) AS spacing FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_size <> b.p_size AND abs(a.p_retailprice - b.p_retailprice) > 0 AND abs(a.p_retailprice - b.p_retailprice) <= 5")
def join_self_pairs(spark, d):
    """Pairs of different depth within a spacing, the cheaper one first met by cells a quarter as wide; rounding may take a pair one cell farther."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice").withColumn("cell", F.floor(F.col("p_retailprice") / 1.25))
    right = p.select("p_brand", F.col("p_partkey").alias("right_key"), F.col("p_size").alias("right_size"), F.col("p_retailprice").alias("right_price"), F.explode(F.array(*[F.col("cell") - i for i in range(6)])).alias("cell"))
    spacing = F.col("right_price") - F.col("p_retailprice")
    # Pairs are many times the rows, so cells are dealt over as many tasks as partitions go.
    dealt = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_brand", "cell")
    met = dealt.join(right.hint("merge"), ["p_brand", "cell"]).filter((F.col("p_size") != F.col("right_size")) & (spacing > 0) & (spacing <= 5))
    return met.select(F.least("p_partkey", "right_key").alias("left_key"), F.greatest("p_partkey", "right_key").alias("right_key"), rounded(spacing, 2).alias("spacing"))


@query(f"""WITH {POINTS}, q AS (SELECT * FROM points WHERE kind = 'purchase'),
  held AS (SELECT q.point_id, arg_min(v.point_id, v.at * 10000000 + v.point_id) AS spot FROM q JOIN points v ON v.kind = 'view' AND v.session_id = q.session_id AND q.at >= v.at AND q.at < v.at + v.k * 600 GROUP BY 1),
  arrived AS (SELECT session_id, at, max(point_id) AS spot FROM points WHERE kind = 'signup' GROUP BY 1, 2),
  entered AS (SELECT session_id, at, max(point_id) AS spot FROM points WHERE kind = 'click' GROUP BY 1, 2)
SELECT q.session_id, q.point_id, coalesce(held.spot, arrived.spot, entered.spot) AS spot,
  CASE WHEN held.spot IS NOT NULL THEN 'SEGMENT' WHEN arrived.spot IS NOT NULL THEN 'PROGRESS' WHEN entered.spot IS NOT NULL THEN 'EVENT' ELSE 'NONE' END AS method
FROM q LEFT JOIN held ON q.point_id = held.point_id
ASOF LEFT JOIN arrived ON q.session_id = arrived.session_id AND q.at >= arrived.at
ASOF LEFT JOIN entered ON q.session_id = entered.session_id AND q.at >= entered.at""")
def join_waypoint_at_cascade(spark, d):
    """The spot of an event: the first segment that holds it, else the last arrival, else the last entry."""
    p = points(spark, d).select("session_id", "point_id", "at", "kind", "k")
    q = _of_kind(p, "purchase").select("session_id", "point_id", "at")
    segments = _of_kind(p, "view").select("session_id", F.col("point_id").alias("spot"), F.col("at").alias("start"), (F.col("at") + F.col("k") * 600).alias("end"))
    held = T.contained_in(q, segments, ["session_id"], "at", "start", "end", width=14_400).groupBy("point_id").agg(F.min_by("spot", F.struct("start", "spot")).alias("held"))
    last = lambda left, kind, prefix: T.as_of(left, _of_kind(p, kind).select("session_id", F.col("at").alias("t"), F.col("point_id").alias("spot")), ["session_id"], "at", "t", "spot", ["spot"], prefix)
    found = last(last(q, "signup", "arrived_"), "click", "entered_").join(held, "point_id", "left")
    method = F.when(F.col("held").isNotNull(), "SEGMENT").when(F.col("arrived_spot").isNotNull(), "PROGRESS").when(F.col("entered_spot").isNotNull(), "EVENT").otherwise("NONE")
    return found.select("session_id", "point_id", F.coalesce("held", "arrived_spot", "entered_spot").alias("spot"), method.alias("method"))


# --- aggregations


@query("WITH h AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') / 2.0 AS uh, count(*) FILTER (WHERE o_orderstatus = 'O') / 4.0 AS prior, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / 500000 AS own, avg(o_totalprice) / 500000 AS everyone FROM orders GROUP BY 1), b AS (SELECT *, uh / (uh + greatest(1e-4, prior)) AS b FROM h) SELECT o_custkey, round(least(1, greatest(0, b * coalesce(own, 0.5) + (1 - b) * everyone)), 6) AS score FROM b")
def agg_blend(spark, d):
    """Own and common score, weighted by hours of own evidence against the prior."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    h = table(spark, d, "orders").groupBy("o_custkey").agg((F.count_if(status == "F") / 2.0).alias("uh"), (F.count_if(status == "O") / 4.0).alias("prior"), (F.avg(F.when(status == "F", price)) / 500000).alias("own"), (F.avg(price) / 500000).alias("everyone"))
    b = F.col("uh") / (F.col("uh") + F.greatest(F.lit(1e-4), "prior"))
    return h.select("o_custkey", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), b * F.coalesce("own", F.lit(0.5)) + (1 - b) * F.col("everyone"))), 6).alias("score"))


@query("SELECT l_linenumber AS version, count(*) AS n, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS success_rate, round(count(*) FILTER (WHERE l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_tax > 0), 0), 6) AS validation_rate FROM lineitem GROUP BY 1")
def agg_outcome_rates(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("version")).agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("success_rate"), F.round(F.count_if(F.col("l_discount") > 0.05) / F.nullif(F.count_if(F.col("l_tax") > 0), F.lit(0)), 6).alias("validation_rate")
    )


@query("SELECT CASE WHEN l_quantity < 5 THEN 'TOO_SMALL' WHEN l_discount > 0.08 THEN 'DISCOUNTED' WHEN l_returnflag = 'R' THEN 'RETURNED' ELSE 'ACCEPTED' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def agg_reason_histogram(spark, d):
    reason = F.when(F.col("l_quantity") < 5, "TOO_SMALL").when(F.col("l_discount") > 0.08, "DISCOUNTED").when(F.col("l_returnflag") == "R", "RETURNED").otherwise("ACCEPTED")
    return table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS pages, bool_or(o_totalprice > 400000) AS exceeded, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1")
def agg_pagination_report(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("pages"), F.bool_or(F.col("o_totalprice") > 400000).alias("exceeded"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))


# --- windows, sets and choices


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def ddp_true_duplicate(spark, d):
    """The best row of each identity; partial maxima instead of sorted groups."""
    best = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("best"))
    return best.select("l_partkey", "l_suppkey", "best.l_orderkey", "best.l_linenumber")


@query(f"WITH {POINTS}, f AS (SELECT session_id, k, min(at * 10000000 + point_id) AS first FROM points GROUP BY 1, 2) SELECT session_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY first) AS ids FROM f GROUP BY 1")
def set_union_distinct_ids(spark, d):
    """Ids in the order in which each first came; only distinct ids are gathered."""
    first = points(spark, d).groupBy("session_id", "k").agg(F.min(_order()).alias("first"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("first", "k"))), lambda x: x["k"].cast("string"))
    return first.groupBy("session_id").agg(F.array_join(ids, ",").alias("ids"))


_SIDE = "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1, 2"


@query(f"WITH a AS ({_SIDE.format('R')}), b AS ({_SIDE.format('A')}) SELECT l_partkey, l_suppkey, n, 'LEFT' AS source FROM a UNION ALL SELECT l_partkey, l_suppkey, n, 'RIGHT' FROM b ANTI JOIN a USING (l_partkey, l_suppkey)")
def set_merge_prefer_left(spark, d):
    """The left side, and of the right side what the left has not; one aggregation serves both."""
    flag = F.col("l_returnflag")
    both = table(spark, d, "lineitem").filter(flag.isin("R", "A")).groupBy("l_partkey", "l_suppkey").agg(F.count_if(flag == "R").alias("l"), F.count_if(flag == "A").alias("r"))
    return both.select("l_partkey", "l_suppkey", F.when(F.col("l") > 0, F.col("l")).otherwise(F.col("r")).alias("n"), F.when(F.col("l") > 0, "LEFT").otherwise("RIGHT").alias("source"))


@query("SELECT n_nationkey, c_custkey AS id, 'AI' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 IN (0, 1) AND c_acctbal > 0 UNION ALL SELECT n_nationkey, s_suppkey, 'CUSTOM' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 3 IN (1, 2) AND s_acctbal > 0 AND (n_nationkey % 3 = 2 OR NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_nationkey = n_nationkey AND c_acctbal > 0))")
def set_union_by_mode(spark, d):
    """Candidates of each area's mode (0 the one source, 1 both, 2 the other), then one row an identity, the first source first."""
    mode = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 3).alias("mode"))
    ai = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("id"), F.lit("AI").alias("source"))
    custom = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("id"), F.lit("CUSTOM").alias("source"))
    rows = ai.join(mode, "n_nationkey").filter("mode IN (0, 1)").unionByName(custom.join(mode, "n_nationkey").filter("mode IN (1, 2)"))
    return rows.groupBy("n_nationkey", "id").agg(F.min("source").alias("source"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200")
def top_pageable(spark, d):
    """One page of a given size; the page is the feature."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(100)


# --- composed algorithms


_WIND = "wind AS (SELECT session_id, at, max(value) AS wind FROM points WHERE kind = 'view' GROUP BY 1, 2)"


def _wind(p: DataFrame) -> DataFrame:
    return _of_kind(p, "view").groupBy("session_id", F.col("at").alias("t")).agg(F.max("value").alias("wind"))


@query(f"""WITH {POINTS}, {_WIND}, q AS (SELECT session_id, point_id, at FROM points WHERE kind = 'click'),
b AS (SELECT q.*, wind.at AS t0, wind.wind AS v0 FROM q ASOF LEFT JOIN wind ON q.session_id = wind.session_id AND q.at >= wind.at),
e AS (SELECT b.*, wind.at AS t1, wind.wind AS v1 FROM b ASOF LEFT JOIN wind ON b.session_id = wind.session_id AND b.at <= wind.at)
SELECT point_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (at - t0) / (t1 - t0) END, 6) AS wind FROM e""")
def alg_weather_at(spark, d):
    """Linear between the values before and after; the end value beyond them."""
    p = points(spark, d).select("session_id", "point_id", "at", "kind", "value")
    wind = _wind(p)
    before = T.as_of(_of_kind(p, "click").select("session_id", "point_id", "at"), wind, ["session_id"], "at", "t", "t", ["t", "wind"], "b_")
    turned = wind.select("session_id", (-F.col("t")).alias("t"), "wind")
    e = T.as_of(before.withColumn("back", -F.col("at")), turned, ["session_id"], "back", "t", "t", ["t", "wind"], "a_")
    t0, v0, t1, v1 = F.col("b_t"), F.col("b_wind"), -F.col("a_t"), F.col("a_wind")
    value = F.when(t0.isNull(), v1).when(t1.isNull() | (t1 == t0), v0).otherwise(v0 + (v1 - v0) * (F.col("at") - t0) / (t1 - t0))
    return e.select("point_id", F.round(value, 6).alias("wind"))


@query(f"""WITH {POINTS}, {_WIND}, q AS (SELECT session_id, point_id, at + part * k * 1800 AS at FROM points, (SELECT unnest([0, 1, 2]) AS part) WHERE kind = 'purchase')
SELECT point_id, max(wind.wind) AS max_wind FROM q ASOF LEFT JOIN wind ON q.session_id = wind.session_id AND q.at >= wind.at GROUP BY 1""")
def alg_interval_max_wind(spark, d):
    """The greatest wind at the start, the middle and the end of an interval."""
    p = points(spark, d).select("session_id", "point_id", "at", "kind", "k", "value")
    moments = F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda i: F.col("at") + i * F.col("k") * 1800))
    q = _of_kind(p, "purchase").select("session_id", "point_id", moments.alias("moment"))
    return T.as_of(q, _wind(p), ["session_id"], "moment", "t", "t", ["wind"], "at_").groupBy("point_id").agg(F.max("at_wind").alias("max_wind"))


@query(f"WITH {POINTS} SELECT session_id, kind, count(*) AS evidence_count, arg_max(k, at * 10000000 + point_id) AS last_value, round(1 - exp(-count(*) / 3.0), 3) AS confidence FROM points GROUP BY 1, 2")
def alg_pref_upsert(spark, d):
    """Evidence counted, the last value kept, confidence from the count."""
    return points(spark, d).groupBy("session_id", "kind").agg(F.count("*").alias("evidence_count"), F.max_by("k", _order()).alias("last_value"), F.round(1 - F.exp(-F.count("*") / F.lit(3.0)), 3).alias("confidence"))


@query(f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at DESC, point_id DESC) AS rn FROM points) SELECT session_id, string_agg(kind || ':' || k, ' ' ORDER BY at, point_id) AS clips FROM r WHERE rn <= 8 GROUP BY 1")
def alg_history_clip(spark, d):
    """The last eight clips of each session, in order; no more than these are gathered."""
    w = Window.partitionBy("session_id").orderBy(F.desc("at"), F.desc("point_id"))
    last = points(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn <= 8")
    clips = F.transform(F.sort_array(F.collect_list(F.struct("at", "point_id", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("clip")))), lambda x: x["clip"])
    return last.groupBy("session_id").agg(F.array_join(clips, " ").alias("clips"))


# --- triggers


@query("WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS attempts FROM events) SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'QUARANTINED' WHEN attempts >= 8 THEN 'FAILED' ELSE 'PENDING' END AS status FROM e")
def stm_retry_quarantine(spark, d):
    """Unknown types are set aside, the rest fail after eight attempts."""
    attempts = F.get_json_object("props", "$.k").cast("long") % 10
    status = F.when(~F.col("event_type").isin("click", "view", "purchase", "signup"), "QUARANTINED").when(attempts >= 8, "FAILED").otherwise("PENDING")
    return table(spark, d, "events").select("event_id", status.alias("status"))
