"""Synthetic inputs: Zipf events and clustered catalogs, made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zipf_events(spark: SparkSession, n: int, users: int, items: int, start_ms: int = 0, step_ms: int = 1, s: float = 1.0, seed: int = 1) -> DataFrame:
    """``n`` events a fixed step apart; items follow a Zipf law with exponent ``s`` (its continuous inverse), every seventh is a like on average."""
    u = F.rand(seed)
    if abs(s - 1) < 1e-9:
        rank = F.pow(F.lit(float(items + 1)), u)
    else:
        rank = F.pow(u * (float(items + 1) ** (1 - s) - 1) + 1, F.lit(1 / (1 - s)))
    return spark.range(n).select(F.col("id").alias("event_id"), (F.lit(start_ms) + F.col("id") * step_ms).alias("event_time_ms"), F.floor(F.rand(seed + 1) * users).cast("long").alias("user_id"), F.least(F.floor(rank) - 1, F.lit(items - 1)).cast("long").alias("item_id"), (F.rand(seed + 2) < 1 / 7).cast("int").alias("type"))


def clustered_catalog(spark: SparkSession, n: int, dim: int, clusters: int = 16, spread: float = 0.25, seed: int = 1) -> DataFrame:
    """``(item_id, embedding)``: unit vectors around random centres; a centre is a function of its number."""
    from marlstone.operators.vectors import l2_normalised

    centre = lambda d: F.sin((F.col("id") % clusters + 1) * (d + 1) * F.lit(12.9898)) * 2
    raw = spark.range(n).select(F.col("id").alias("id"), F.array(*(F.randn(seed + d) for d in range(dim))).alias("noise"))
    v = raw.select("id", F.transform("noise", lambda x, d: centre(d) + spread * x).alias("v"))
    return v.select(F.col("id").alias("item_id"), F.transform(l2_normalised(F.col("v")), lambda x: x.cast("float")).alias("embedding"))


def watched(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """``(user, item, ts, watch)`` from logs whose columns have one of several names; rows without user or item go."""
    names = {"user": ["user_id", "user"], "item": ["video_id", "item_id", "item"], "ts": ["timestamp", "time", "ts"], "watch": ["watch_ratio", "watch"]}
    kinds = {"user": "long", "item": "long", "ts": "double", "watch": "float"}

    def first(options: list[str]):
        there = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in options if c in raw.columns]
        return F.coalesce(*there) if there else F.lit(None)

    found = raw.select(*(first(o).cast(kinds[k]).alias(k) for k, o in names.items())).filter("user is not null and item is not null")
    found = found.withColumn("ts", F.coalesce(F.col("ts"), F.lit(0)).cast("long")).na.fill({"watch": 0.0})
    return found if limit is None else found.limit(limit)
