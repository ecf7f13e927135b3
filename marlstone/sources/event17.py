"""The packed 17-byte event record: u64 time, u32 user, u32 item, u8 type, little-endian, read and written by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 17


def _swapped(hex_: Column, n: int) -> Column:
    return F.concat(*(F.substring(hex_, 2 * (n - i) - 1, 2) for i in range(n)))


def encode(events: DataFrame) -> DataFrame:
    """``events`` with ``payload``: one packed record per row."""
    part = lambda c, n: _swapped(F.lpad(F.hex(F.col(c).cast("long")), 2 * n, "0"), n)
    return events.withColumn("payload", F.unhex(F.concat(part("event_time_ms", 8), part("user_id", 4), part("item_id", 4), part("type", 1))))


def decode(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Columns of each 17-byte payload; payloads of another length give nulls and ``bad`` true."""
    h = F.hex(F.col(payload))
    num = lambda at, n: F.conv(_swapped(F.substring(h, 2 * at + 1, 2 * n), n), 16, 10).cast("decimal(20,0)")
    ok = F.length(payload) == RECORD
    long = lambda at, n: F.when(ok & (num(at, n) <= 2**63 - 1), num(at, n).cast("long"))
    return payloads.select("*", long(0, 8).alias("event_time_ms"), long(8, 4).alias("user_id"), long(12, 4).alias("item_id"), long(16, 1).cast("int").alias("type"), (~F.coalesce(ok, F.lit(False))).alias("bad"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Whole event files; ``seq`` is the order within a file, and a record cut short at the end is left out."""
    whole = spark.read.format("binaryFile").load(path).select("path", "content", (F.length("content") / RECORD).cast("int").alias("n"))
    at = whole.filter("n > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    return decode(at.select("path", F.col("seq").cast("long").alias("seq"), F.substring("content", F.col("seq") * RECORD + 1, F.lit(RECORD)).alias("payload"))).drop("payload")
