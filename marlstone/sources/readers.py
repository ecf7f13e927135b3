"""Readers with fixed schemas: interactions, ratings, movies, and an optional Kafka source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def interactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """``user, item, ts, watch``; rows that do not parse are skipped, a missing ``watch`` is 0."""
    rows = spark.read.schema("user long, item long, ts long, watch float").csv(path, header=True, mode="PERMISSIVE")
    return rows.filter("user is not null and item is not null and ts is not null").na.fill({"watch": 0.0})


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("userId long, movieId long, rating float, timestamp long").csv(path, header=True, mode="FAILFAST")


def movies_csv(spark: SparkSession, path: str) -> DataFrame:
    """Title, year from a trailing ``(1999)``, genres as an array."""
    raw = spark.read.schema("movieId int, title string, genres string").csv(path, header=True, mode="FAILFAST")
    year = F.regexp_extract("title", r"\((\d{4})\)\s*$", 1)
    return raw.select("movieId", "title", F.when(year != "", year.cast("int")).alias("year"), F.split("genres", "[|]").alias("genres"))


def kafka_payloads(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """Raw payloads from the earliest offset; needs Spark's Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("value").alias("payload"), "partition", "offset")
