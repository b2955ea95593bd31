"""The streaming forms over the driver's events, run to their end as batch plans, and the table sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.registry import register
from graphloom.sources import sinks
from graphloom.streaming import windows as W


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_BUCKET = "TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts) / {0}) * {0} AS BIGINT))"


@register(
    "stream_tumbling_counts",
    f"SELECT strftime({_BUCKET.format(604800)}, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
)
def _tumbling(spark, sf):
    return W.event_counts(_events(spark, sf)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@register(
    "stream_sliding_counts",
    """SELECT strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts) / 43200) * 43200 - k * 43200 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(value) AS total
    FROM events, unnest([0, 1]) q(k) GROUP BY 1, 2""",
)
def _sliding(spark, sf):
    return W.event_counts(_events(spark, sf), "1 day", "12 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@register(
    "stream_sessions",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
    y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM y GROUP BY user_id, s""",
)
def _sessions(spark, sf):
    return W.sessions(_events(spark, sf), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("sink_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT -c_custkey, c_acctbal + 1, 'NEW' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 0")
def _upsert(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_acctbal", "c_mktsegment")
    some = c.filter("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    fresh = some.filter("c_custkey > 0").withColumn("c_custkey", -F.col("c_custkey"))
    return sinks.upsert(c, some.union(fresh), ["c_custkey"], keep_first=("c_mktsegment",))
