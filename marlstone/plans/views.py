"""Logical views of the engine over the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, event_time_ms, user_id, item_id, type)``; event_id is the order of arrival."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        (F.col("event_type") == "purchase").cast("int").alias("type"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, item, ts, rating)``: one row per user and item, first time and best rating."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(
        F.min(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ts"), F.max(F.ceil(F.col("l_quantity") / 5) / 2.0).cast("double").alias("rating")
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, event_id, user_id, item_id, kind, event_time_ms)`` of the feedback journal."""
    kind = F.create_map(*(F.lit(x) for pair in {"click": "shown", "purchase": "save", "error": "dismiss", "view": "watched"}.items() for x in pair))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("other")).alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"))


EVT = "evt AS (SELECT event_id, (epoch_us(ts) // 1000) AS event_time_ms, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS type FROM events)"
INTER = "inter AS (SELECT o_custkey AS \"user\", l_partkey AS item, min((epoch_us(o_orderdate) // 1000)) AS ts, max(ceil(l_quantity / 5) / 2.0) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
JOURNAL = "journal AS (SELECT event_id AS seq, event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CASE event_type WHEN 'click' THEN 'shown' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'dismiss' WHEN 'view' THEN 'watched' ELSE 'other' END AS kind, (epoch_us(ts) // 1000) AS event_time_ms FROM events)"
