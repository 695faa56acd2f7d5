"""Queries of scans, filters, joins, aggregations, ranked choices and keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions.scores import preference_confidence, rate
from driftline.operators import relational as R
from driftline.plans.base import epoch, query, table


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def src_table(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%'")
def flt_ci_like(spark, d):
    return table(spark, d, "part").filter(R.contains_ci("p_name", "RING")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def flt_optional_params(spark, d):
    rows = R.optional_filters(table(spark, d, "orders"), o_orderpriority="5-LOW", o_orderstatus=None).filter("o_orderstatus <> 'P'")
    rows = rows.filter(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 40 AND o_totalprice BETWEEN 1000 AND 200000")
def flt_range_between(spark, d):
    return table(spark, d, "orders").filter(F.col("o_custkey").between(10, 40) & F.col("o_totalprice").between(1000, 200000)).select("o_orderkey", "o_totalprice")


_DEPTHS = "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE -p_size END AS lo, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size + 6 END AS hi FROM part"


def _depths(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(size % 5 != 0, -size).alias("lo"), F.when(size % 7 != 0, size + 6).alias("hi"))


@query(f"WITH t AS ({_DEPTHS}) SELECT p_partkey FROM t WHERE (lo IS NULL AND hi IS NULL) OR (abs(coalesce(lo, hi)) BETWEEN 10 AND 40 AND abs(coalesce(hi, lo)) BETWEEN 10 AND 40)")
def flt_depth_containment(spark, d):
    inside = lambda a, b: F.abs(F.coalesce(a, b)).between(10, 40)
    return _depths(spark, d).filter((F.col("lo").isNull() & F.col("hi").isNull()) | (inside("lo", "hi") & inside("hi", "lo"))).select("p_partkey")


@query(f"WITH t AS ({_DEPTHS}) SELECT p_partkey, least(abs(lo), abs(hi)) AS min_depth, greatest(abs(lo), abs(hi)) AS max_depth, (coalesce(abs(lo), abs(hi)) + coalesce(abs(hi), abs(lo))) / 2.0 AS depth FROM t")
def prj_depth_swap(spark, d):
    lo, hi = F.abs("lo"), F.abs("hi")
    return _depths(spark, d).select("p_partkey", F.least(lo, hi).alias("min_depth"), F.greatest(lo, hi).alias("max_depth"), ((F.coalesce(lo, hi) + F.coalesce(hi, lo)) / F.lit(2.0)).alias("depth"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey = 3 AND l_quantity = 10")
def flt_multi_key_exact(spark, d):
    return R.optional_filters(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus="F", l_suppkey=3, l_quantity=10).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, user_id FROM events WHERE CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END IS NOT NULL")
def flt_not_null_project(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").withColumn("zone", F.when(F.col("event_type") == "click", k)).filter("zone IS NOT NULL").select("event_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def flt_existing_keys(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def flt_time_ge_lt(spark, d):
    return table(spark, d, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-06").cast("timestamp_ntz"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderdate <= TIMESTAMP '1997-06-01') AND (o_orderstatus = 'F' OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1997-06-01')")
def flt_valid_on_date(spark, d):
    day = F.lit("1997-06-01").cast("timestamp_ntz")
    rows = table(spark, d, "orders").withColumns({"valid_from": F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")), "valid_to": F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))})
    return rows.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))).select("o_orderkey")


@query("SELECT s_suppkey, least(6000.0, s_acctbal / 2, 15.0 * 3600 * 0.25) AS reach FROM supplier WHERE s_nationkey * 300.0 <= least(6000.0, s_acctbal / 2, 15.0 * 3600 * 0.25)")
def flt_boat_range(spark, d):
    reach = F.least(F.lit(6000.0), F.col("s_acctbal") / 2, F.lit(15.0 * 3600 * 0.25))
    return table(spark, d, "supplier").withColumn("reach", reach).filter(F.col("s_nationkey") * 300.0 <= F.col("reach")).select("s_suppkey", "reach")


_REASON = "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'REGULATION' WHEN l_quantity > 45 THEN 'ACCESS' WHEN l_extendedprice > 70000 THEN 'RANGE' WHEN l_tax >= 0.08 THEN 'SAFETY' END"


@query(f"SELECT coalesce({_REASON}, 'ACCEPTED') AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def flt_chain_with_reasons(spark, d):
    rules = [("REGULATION", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")), ("ACCESS", F.col("l_quantity") > 45), ("RANGE", F.col("l_extendedprice") > 70000), ("SAFETY", F.col("l_tax") >= 0.08)]
    return table(spark, d, "lineitem").groupBy(F.coalesce(R.first_reason(rules), F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value >= 200 THEN 'REJECT' WHEN value >= 80 THEN 'WIND_PENALTY' ELSE 'ACCEPT' END AS verdict FROM events")
def flt_safety(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v >= 200, "REJECT").when(v >= 80, "WIND_PENALTY").otherwise("ACCEPT").alias("verdict"))


@query("SELECT DISTINCT p_name, replace(upper(trim(p_name)), ' ', '_') AS code FROM part")
def prj_normalize_code(spark, d):
    return table(spark, d, "part").select("p_name", F.replace(F.upper(F.trim("p_name")), F.lit(" "), F.lit("_")).alias("code")).distinct()


@query("SELECT p_partkey, CAST(CASE WHEN p_type = 'ECONOMY' THEN CAST(p_size AS DECIMAL(10,2)) * CAST(0.3048 AS DECIMAL(5,4)) ELSE p_size END AS DECIMAL(12,2)) AS metres FROM part")
def prj_unit_feet(spark, d):
    size = F.col("p_size").cast("decimal(10,2)")
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "ECONOMY", F.round(size * F.lit(0.3048).cast("decimal(5,4)"), 2)).otherwise(size).cast("decimal(12,2)").alias("metres"))


@query("SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'BASS' WHEN 'MACHINERY' THEN 'PIKE' END, 'OTHER') AS species FROM customer")
def prj_species_map(spark, d):
    names = spark.createDataFrame([("BUILDING", "BASS"), ("MACHINERY", "PIKE")], "c_mktsegment string, species string")
    return table(spark, d, "customer").join(F.broadcast(names), "c_mktsegment", "left").select("c_custkey", F.coalesce("species", F.lit("OTHER")).alias("species"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_inner_fk(spark, d):
    # Nations and regions are small enough for Spark's own broadcast; orders and customers meet on their key.
    orders, customer, nation, region = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    sums = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    named = sums.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0")
def join_theta_implicit(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("SELECT p_partkey FROM part WHERE p_size >= 25 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 48)")
def join_semi_anti_notexists(spark, d):
    part, used = table(spark, d, "part"), table(spark, d, "lineitem").filter("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return part.filter("p_size >= 25").select("p_partkey").unionByName(part.filter("p_size < 25").join(used, "p_partkey", "left_semi").select("p_partkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IS NOT NULL)")
def join_anti_notin(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'RETURNED' ELSE o_orderstatus END AS status FROM orders")
def join_exists_migration(spark, d):
    back = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("back", F.lit(True))
    return table(spark, d, "orders").join(back, "o_orderkey", "left").select("o_orderkey", F.when(F.col("back"), "RETURNED").otherwise(F.col("o_orderstatus")).alias("status"))


_GRAIN = "SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS priority, o_orderkey, o_custkey, o_totalprice FROM orders"


def _grain(spark, d):
    return table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("priority"), "o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH g AS ({_GRAIN}), a AS (SELECT status, priority, count(*) AS n FROM g GROUP BY ALL), b AS (SELECT status, priority, max(o_orderkey) AS newest FROM g WHERE o_totalprice > 400000 GROUP BY ALL) SELECT a.status, a.priority, n, newest FROM a JOIN b ON a.status IS NOT DISTINCT FROM b.status AND a.priority IS NOT DISTINCT FROM b.priority")
def join_null_safe(spark, d):
    g = _grain(spark, d)
    a = g.groupBy("status", "priority").agg(F.count("*").alias("n"))
    b = g.filter("o_totalprice > 400000").groupBy("status", "priority").agg(F.max("o_orderkey").alias("newest"))
    return a.join(b, R.null_safe(a, b, ["status", "priority"])).select(a["status"], a["priority"], "n", "newest")


@query("SELECT c_custkey, n_name, o_orderkey AS latest FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1) o ON o_custkey = c_custkey")
def join_nplus1_lookup(spark, d):
    newest = R.first_per_key(table(spark, d, "orders"), ["o_custkey"], F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey"))
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", F.col("o_orderkey").alias("latest"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def agg_count_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS landed FROM lineitem GROUP BY 1, 2")
def agg_count_filter(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("landed"))


@query("WITH u AS (SELECT l_partkey AS feature, l_suppkey AS user_id, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS effort FROM lineitem GROUP BY 1, 2), g AS (SELECT feature, sum(n) AS n_all, sum(effort) AS effort_all FROM u GROUP BY 1) SELECT u.feature, user_id, n, effort, CAST(n_all AS BIGINT) AS n_all, CAST(effort_all AS BIGINT) AS effort_all FROM u JOIN g ON u.feature = g.feature")
def agg_two_level(spark, d):
    u = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("effort"))
    return u.join(u.groupBy("feature").agg(F.sum("n").alias("n_all"), F.sum("effort").alias("effort_all")), "feature")


@query("WITH a AS (SELECT l_suppkey AS zone, count(*) AS landed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT s_suppkey AS zone, s_acctbal AS hours FROM supplier WHERE s_acctbal > 2000) SELECT coalesce(a.zone, b.zone) AS zone, coalesce(landed, 0) AS landed, hours FROM a FULL JOIN b ON a.zone = b.zone")
def agg_paired_key(spark, d):
    a = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("zone")).agg(F.count("*").alias("landed"))
    b = table(spark, d, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("zone"), F.col("s_acctbal").alias("hours"))
    return a.join(b, "zone", "full").select("zone", F.coalesce("landed", F.lit(0)).alias("landed"), "hours")


@query("SELECT user_id, count(DISTINCT coalesce(CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END, -event_id)) AS fish FROM events GROUP BY 1")
def agg_distinct_count_expr(spark, d):
    k = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("long"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(F.coalesce(k, -F.col("event_id"))).alias("fish"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer")
def agg_scalar_subqueries(spark, d):
    n = lambda t, key, name: table(spark, d, t).groupBy(F.col(key).alias("c_custkey")).agg(F.count("*").alias(name))
    out = table(spark, d, "customer").join(n("orders", "o_custkey", "n_orders"), "c_custkey", "left").join(n("events", "user_id", "n_events"), "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("WITH g AS (SELECT md5(lower(trim(text))) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM g")
def agg_having_dup(spark, d):
    g = table(spark, d, "documents").groupBy(F.md5(F.lower(F.trim("text"))).alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.09) AS bad_confidence, count(*) FILTER (WHERE l_extendedprice > 90000) AS absurd, count(*) FILTER (WHERE l_shipdate IS NULL) AS undated FROM lineitem")
def agg_dq_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.09)).alias("bad_confidence"), F.count_if(F.col("l_extendedprice") > 90000).alias("absurd"), F.count_if(F.col("l_shipdate").isNull()).alias("undated"))


@query(f"WITH g AS ({_GRAIN}) SELECT count(*) AS n, coalesce(sum(o_custkey), 0) :: BIGINT AS total FROM g WHERE status IS NOT DISTINCT FROM NULL AND priority IS NOT DISTINCT FROM '5-LOW'")
def agg_sum_dynamic_filter(spark, d):
    return R.dynamic_null_safe(_grain(spark, d), {"status": None, "priority": "5-LOW"}).agg(F.count("*").alias("n"), F.coalesce(F.sum("o_custkey"), F.lit(0)).alias("total"))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value >= 0 GROUP BY 1")
def agg_pctl_nearest_rank(spark, d):
    return table(spark, d, "events").filter("value >= 0").groupBy("event_type").agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(f"p{round(100 * p)}") for p in (0.5, 0.95)])


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value AS p25 FROM r WHERE i = floor((n - 1) * 0.25)")
def agg_pctl_floor(spark, d):
    of_user = Window.partitionBy("user_id")
    r = table(spark, d, "events").withColumns({"i": F.row_number().over(of_user.orderBy("value", "event_id")) - 1, "n": F.count("*").over(of_user)})
    return r.filter("i = floor((n - 1) * 0.25)").select("user_id", F.col("value").alias("p25"))


@query("SELECT user_id, median(value) AS median FROM events GROUP BY 1")
def agg_median(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("median"))


@query("SELECT event_type, count(*) AS total, CAST(sum(k % 2) AS BIGINT) AS part, sum(k % 2) / CASE WHEN count(*) > 0 THEN count(*) END AS share, CASE WHEN sum(k // 90) > 0 THEN sum(k % 2) / sum(k // 90) END AS ratio FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def agg_rates(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    sums = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.sum(k % 2).alias("part"), F.sum(F.floor(k / 90)).alias("tens"))
    return sums.select("event_type", "total", "part", rate("part", "total").alias("share"), rate("part", "tens").alias("ratio"))


@query("SELECT l_partkey, count(*) AS members, round(avg(CASE WHEN l_discount > 0 AND NOT isnan(l_extendedprice) THEN l_extendedprice END), 4) AS mean_price, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1")
def agg_zone_mean(spark, d):
    finite = F.when((F.col("l_discount") > 0) & ~F.isnan("l_extendedprice"), F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("members"), F.round(F.avg(finite), 4).alias("mean_price"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.total') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 10) AS tokens, round(coalesce(CAST(json_extract_string(props, '$.total') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 10) / 1000.0 * 0.25, 6) AS cost FROM events")
def agg_usage_cost(spark, d):
    k = lambda name: F.get_json_object("props", f"$.{name}").try_cast("long")
    tokens = F.coalesce(k("total"), F.coalesce(k("k"), k("input")) + F.col("event_id") % 10)
    return table(spark, d, "events").select("event_id", tokens.alias("tokens")).withColumn("cost", F.round(F.col("tokens") / 1000.0 * 0.25, 6))


@query("SELECT user_id, event_type, count(*) AS n, round((1 - exp(-count(*) / 3.0)) * exp(-ln(2) * ((1706659200 - max(epoch_us(ts) // 1000000)) / 86400.0) / 14), 3) AS confidence FROM events GROUP BY 1, 2")
def agg_preference_conf(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(epoch("ts")).alias("last"))
    return g.select("user_id", "event_type", "n", preference_confidence("n", (F.lit(1706659200) - F.col("last")) / 86400.0, 14).alias("confidence"))


@query("SELECT o_custkey, CAST(100 - count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS left_over FROM orders GROUP BY 1")
def agg_quota(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.lit(100) - F.count_if(F.col("o_orderstatus") != "F")).alias("left_over"))


@query("SELECT l_returnflag, count(*) AS cases, count(*) FILTER (WHERE l_linestatus = 'F') AS passed, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_quantity < 5) AS skipped, count(*) FILTER (WHERE l_linestatus = 'F') >= 0.5 * count(*) AS gate FROM lineitem GROUP BY 1")
def agg_coverage(spark, d):
    passed = F.count_if(F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("cases"), passed.alias("passed"), F.count_if((F.col("l_linestatus") != "F") & (F.col("l_quantity") < 5)).alias("skipped"), (passed >= 0.5 * F.count("*")).alias("gate"))


@query("WITH v AS (SELECT user_id AS case_id, event_type AS version, max_by(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3, event_id) AS action FROM events GROUP BY 1, 2) SELECT a.version AS v1, b.version AS v2, count(*) AS cases, round(avg(CASE WHEN a.action = b.action THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM v a JOIN v b ON a.case_id = b.case_id AND a.version < b.version GROUP BY 1, 2")
def agg_version_agreement(spark, d):
    k = F.get_json_object("props", "$.k").cast("long") % 3
    v = table(spark, d, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("version")).agg(F.max_by(k, "event_id").alias("action"))
    a, b = v.select("case_id", F.col("version").alias("v1"), F.col("action").alias("a1")), v.select("case_id", F.col("version").alias("v2"), F.col("action").alias("a2"))
    return a.join(b, "case_id").filter("v1 < v2").groupBy("v1", "v2").agg(F.count("*").alias("cases"), F.round(F.avg((F.col("a1") == F.col("a2")).cast("double")), 6).alias("agreement"))


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1")
def top_first_per_group(spark, d):
    return R.first_per_key(table(spark, d, "customer"), ["c_nationkey"], F.asc("c_acctbal"), F.asc("c_custkey")).select("c_nationkey", "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def top_limit(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8).select("o_orderkey", "o_totalprice")


@query("SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 10")
def top_per_type_cap(spark, d):
    return R.capped_per_type(table(spark, d, "part"), "p_type", 10, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_type", "p_partkey")


@query("WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier) SELECT s_suppkey, s_nationkey FROM r ORDER BY turn, s_nationkey LIMIT 32")
def top_round_robin(spark, d):
    return R.round_robin(table(spark, d, "supplier"), "s_nationkey", 32, F.desc("s_acctbal"), F.asc("s_suppkey")).select("s_suppkey", "s_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def srt_total_order(spark, d):
    return table(spark, d, "lineitem").orderBy(F.asc_nulls_last("l_shipdate"), "l_linenumber", F.col("l_orderkey").cast("string")).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT p_name, p_partkey, n FROM (SELECT p_name, p_partkey, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def ddp_identity(spark, d):
    counted = table(spark, d, "part").withColumn("n", F.count("*").over(Window.partitionBy("p_name")))
    return R.first_per_key(counted, ["p_name"], F.desc("p_retailprice"), F.asc("p_partkey"), null_keys_stay=True).select("p_name", "p_partkey", "n")


@query("WITH t AS (SELECT p_brand, p_partkey, p_size, p_retailprice, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM part) SELECT p_brand, p_size, p_retailprice FROM t WHERE best IS NULL OR p_retailprice > best + 1e-9")
def ddp_nondominated(spark, d):
    return R.skyline(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice").select("p_brand", "p_size", "p_retailprice")


@query("SELECT DISTINCT key FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT user_id FROM events UNION ALL SELECT s_suppkey FROM supplier)")
def set_eligible_keys(spark, d):
    keys = lambda t, c: table(spark, d, t).select(F.col(c).alias("key"))
    return keys("orders", "o_custkey").unionByName(keys("events", "user_id")).unionByName(keys("supplier", "s_suppkey")).distinct()


# --- keyed writes: the state that the target has afterwards

_HALVES = "a AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_type NOT IN ('view', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), b AS (SELECT user_id, event_id, CASE WHEN value > 40 THEN event_type END AS event_type, value FROM events WHERE event_type IN ('view', 'signup'))"


def _halves(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    a = R.first_per_key(e.filter("event_type NOT IN ('view', 'signup')"), ["user_id"], F.desc("event_id"))
    return a, e.filter("event_type IN ('view', 'signup')").withColumn("event_type", F.when(F.col("value") > 40, F.col("event_type")))


@query(f"WITH {_HALVES}, n AS (SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type FROM b GROUP BY 1) SELECT coalesce(n.user_id, a.user_id) AS user_id, coalesce(n.event_id, a.event_id) AS event_id, coalesce(n.event_type, a.event_type) AS event_type, coalesce(n.value, a.value) AS value FROM a FULL JOIN n ON a.user_id = n.user_id")
def snk_upsert_latest(spark, d):
    a, b = _halves(spark, d)
    return R.upsert(a, b, ["user_id"], [F.desc("event_id")], keep_if_null=("event_type",))


@query(f"WITH {_HALVES} SELECT user_id, event_id, event_type, value FROM a UNION ALL SELECT user_id, event_id, event_type, value FROM b WHERE user_id NOT IN (SELECT user_id FROM a) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def snk_insert_ignore(spark, d):
    a, b = _halves(spark, d)
    return R.insert_ignore(a, b, ["user_id"], [F.asc("event_id")])


_CONTRIB = "old AS (SELECT l_orderkey AS session_id, l_returnflag AS flag, l_linestatus AS status, CAST(sum(l_quantity) AS BIGINT) AS effort, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), new AS (SELECT session_id, CASE WHEN n > 1 THEN 'X' ELSE flag END AS flag, status, effort + 1 AS effort, n FROM old WHERE effort > 90)"


def _contributions(spark, d):
    old = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.sum("l_quantity").cast("long").alias("effort"), F.count("*").alias("n"))
    new = old.filter("effort > 90").withColumn("flag", F.when(F.col("n") > 1, "X").otherwise(F.col("flag"))).withColumn("effort", F.col("effort") + 1)
    return old, new


@query(f"WITH {_CONTRIB} SELECT * FROM old WHERE session_id NOT IN (SELECT session_id FROM new) UNION ALL SELECT * FROM new")
def snk_replace_session(spark, d):
    old, new = _contributions(spark, d)
    return R.replace_keys(old, new, ["session_id"])


@query(f"WITH {_CONTRIB}, now AS (SELECT * FROM old WHERE session_id NOT IN (SELECT session_id FROM new) UNION ALL SELECT * FROM new), hit AS (SELECT flag, status FROM old WHERE session_id IN (SELECT session_id FROM new) UNION SELECT flag, status FROM new) SELECT flag, status, CAST(sum(effort) AS BIGINT) AS effort, CAST(sum(n) AS BIGINT) AS n FROM now WHERE (flag, status) IN (SELECT (flag, status) FROM hit) GROUP BY 1, 2")
def snk_rebuild_grains(spark, d):
    """Replaced sessions and the grains that they touch, from one scan."""
    old, _ = _contributions(spark, d)
    new = F.when(F.col("effort") > 90, F.struct(F.when(F.col("n") > 1, "X").otherwise(F.col("flag")).alias("flag"), "status", (F.col("effort") + 1).alias("effort"), "n"))
    return R.replace_and_rebuild(old, "session_id", new, ["flag", "status"], ["effort", "n"])


@query(f"WITH {_CONTRIB} SELECT flag, status FROM old WHERE session_id IN (SELECT session_id FROM new) UNION SELECT flag, status FROM new")
def set_affected(spark, d):
    old, new = _contributions(spark, d)
    return R.affected_grains(old.join(new.select("session_id").distinct(), "session_id", "left_semi"), new, ["flag", "status"])


@query("SELECT page_id, sha256(html) AS sha256, length(html) AS chars FROM pages")
def snk_raw_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.length("html").cast("long").alias("chars"))


@query("SELECT user_id, count(*) AS n_open FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1 HAVING count(*) > 1")
def dq_open_rows(spark, d):
    return R.violations(table(spark, d, "events"), ["user_id"], (F.col("event_type") == "error") & (F.col("value") > 100))
