"""Uniform sharding by a hypergeometric communication matrix (operator 4)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import as_row, materialize


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each source partition sends to each shard, drawn as a uniform shuffle of all rows would.

    Column sums are the shard sizes, equal up to one; row sums are ``counts``.  Each partition draws
    without replacement from the places that are still free: a multivariate hypergeometric.
    """
    total = sum(counts)
    free = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    rows = np.zeros((len(counts), shards), dtype=np.int64)
    for i, n in enumerate(counts):
        if n:
            rows[i] = rng.multivariate_hypergeometric(free, n, method="marginals")
            free -= rows[i]
    return rows


def shard(df: DataFrame, shards: int = 24, seed: int = 17, bucket_rows: int = 1 << 20) -> DataFrame:
    """``(row, shard, slot)`` for every row of ``df``: a uniform shuffle into shards whose counts differ by one at most.

    Each source partition is permuted locally, the matrix says which of its ranks go to which
    shard, and each shard is permuted again; ``slot`` numbers a shard's rows from 0 without gaps.
    The second permutation splits a shard into buckets of about ``bucket_rows`` by random key, so
    no task sorts a whole shard.  To the driver come one count per source partition, and one per
    shard and bucket.  Rows are written to the shared scratch folder with their source
    partition and position first, so a lost executor cannot deal them differently.

    Only row counts matter: nulls, ties, repeated rows and empty texts are rows like any other.
    """
    spark = df.sparkSession
    placed = as_row(df).select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    placed, _ = materialize(placed, "shard-rows")
    found = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in found)
    matrix = communication_matrix([n for _, n in found], shards, seed)
    bounds = spark.createDataFrame([(p, np.cumsum(m).tolist()) for (p, _), m in zip(found, matrix, strict=True)], "part int, upto array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64("at", F.lit(seed)), "at")
    ranked = placed.withColumn("rank", F.row_number().over(local)).join(bounds, "part")
    dealt = ranked.select("row", "at", F.size(F.filter("upto", lambda c: c < F.col("rank"))).alias("shard"))
    buckets = max(1, -(-total // (shards * bucket_rows)))
    key = F.xxhash64("at", F.lit(seed + 1))
    dealt, _ = materialize(dealt.withColumn("key", key).withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")), "shard-dealt")
    sizes = sorted((r["shard"], r.bucket, r.n) for r in dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).collect())
    offsets, before, last = [], 0, None
    for s, b, n in sizes:
        before = 0 if s != last else before
        offsets.append((s, b, before))
        before, last = before + n, s
    again = Window.partitionBy("shard", "bucket").orderBy("key", "at")
    numbered = dealt.withColumn("n", F.row_number().over(again)).join(spark.createDataFrame(offsets, "shard int, bucket int, before long"), ["shard", "bucket"])
    return numbered.select("row", "shard", (F.col("before") + F.col("n") - 1).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order within each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
