"""Relational queries that the substrate offers beside the domain's operators: joins, sets, windows, time, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.session import table


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


def join_revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda name: table(spark, folder, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


def semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    bought = customers.join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("c_mktsegment", F.lit("with").alias("kind"), "n")
    never = customers.join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")).select("c_mktsegment", F.lit("without").alias("kind"), "n")
    return bought.unionByName(never)


def asof_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with the last view of its user before it, by one sort of both."""
    events = table(spark, folder, "events").where("event_type in ('view', 'purchase')").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "view", F.col("ts")), ignorenulls=True).over(w)
    return events.withColumn("viewed_at", last).where("event_type = 'purchase'").select("event_id", "user_id", "ts", "viewed_at")


def range_join(spark: SparkSession, folder: str) -> DataFrame:
    """Errors within an hour after a signup of the same user; time buckets make it an equi-join."""
    events = table(spark, folder, "events").select("user_id", "event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    a = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup"), F.col("s").alias("from_s"), F.explode(F.array((F.col("s") / 3600).cast("long"), (F.col("s") / 3600).cast("long") + 1)).alias("bucket"))
    b = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), "s", (F.col("s") / 3600).cast("long").alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where("s >= from_s and s <= from_s + 3600").select("user_id", "signup", "error")


def cube_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


def rollup_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))
    return rows.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_size", F.lit(-1)).alias("size"), "n", "price")


def window_rank(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("place"), F.ntile(4).over(w).alias("quarter"))
    return rows.where("place <= 10")


def window_lag(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.lag("o_orderdate").over(w).alias("before"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"))
    return rows.select("o_orderkey", F.coalesce(F.datediff("o_orderdate", "before"), F.lit(-1)).alias("days"), "last_three")


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    customers, suppliers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")), table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"))
    both = customers.intersect(suppliers).select(F.lit("both").alias("kind"), "k")
    return both.unionAll(customers.exceptAll(suppliers).distinct().select(F.lit("more"), "k")).unionAll(customers.union(suppliers).distinct().select(F.lit("any"), "k"))


def tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "v")


def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def json_properties(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("highest"))


def distinct_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("users"), F.percentile_approx("value", 0.5, 10_000).alias("median"))


QUERIES = {f.__name__: f for f in (pricing_summary, join_revenue_by_nation, semi_anti, asof_join, range_join, cube_orders, rollup_parts, window_rank, window_lag, set_operations, tumbling_window, session_windows, json_properties, distinct_sketch)}
ORACLE = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "join_revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "semi_anti": "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'with' ELSE 'without' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2",
    "asof_join": "SELECT p.event_id, p.user_id, p.ts, max(v.ts) AS viewed_at FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1, 2, 3",
    "range_join": "SELECT a.user_id, a.event_id AS signup, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'error' AND epoch(b.ts)::BIGINT BETWEEN epoch(a.ts)::BIGINT AND epoch(a.ts)::BIGINT + 3600",
    "cube_orders": "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup_parts": "SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_size, -1) AS size, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "window_rank": "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER w::INT AS place, ntile(4) OVER w::INT AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE place <= 10",
    "window_lag": "SELECT o_orderkey, coalesce(date_diff('day', lag(o_orderdate) OVER w, o_orderdate), -1)::INT AS days, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "set_operations": "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT 'more', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)",
    "tumbling_window": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "session_windows": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1",
    "json_properties": "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS highest FROM events GROUP BY 1",
}
