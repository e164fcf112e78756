"""Conventional analytics, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from ..streaming import windows
from . import query
from . import tables as tb


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def olap_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.sum_by(tb.table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice"))
    return out.withColumn("total", F.round("total", 2))


@query("SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', ts)::INTEGER AS day, count(*) AS events FROM events GROUP BY 1, 2")
def olap_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("datediff(cast(ts as date), date'2024-01-01')").alias("day")
    return tb.table(spark, sf_dir, "events").groupBy("event_type", day).agg(F.count(F.lit(1)).alias("events"))


@query("SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY user_id")
def olap_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))


@query("WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[floor(len(v) * 0.95)::INTEGER + 1] AS value FROM l")
def olap_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.p95_exact(tb.table(spark, sf_dir, "events"), "event_type", "value")


@query()
def olap_p95_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.p95_approx(tb.table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL")
def olap_highcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def olap_join_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = tb.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), tb.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").alias("revenue"))
    return out.withColumn("revenue", F.round("revenue", 2))


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def olap_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = tb.table(spark, sf_dir, "lineitem").select("l_orderkey"), tb.table(spark, sf_dir, "orders").select("o_orderkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, max(l_extendedprice) AS most FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber IN (1, 2, 3)")
def olap_filtered_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tb.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A") & F.col("l_linenumber").isin(1, 2, 3))
    return li.agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("most"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS window_end, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(tb.table(spark, sf_dir, "events"), "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""SELECT w AS window_start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS w FROM events) GROUP BY ALL""")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(tb.table(spark, sf_dir, "events"), "1 hour", "30 minutes", ["event_type"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
          SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '2 hours' AS session_end, count(*) AS events FROM n GROUP BY user_id, i""")
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(tb.table(spark, sf_dir, "events"), "2 hours", "user_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1800000000 ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rate_limited(tb.table(spark, sf_dir, "events"), 2, "event_type", seconds=1800, tie="event_id").select("event_id", "allowed")
