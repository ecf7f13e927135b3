"""Preferences, deletions and releases: last-write-wins tables, ledgers, and verified bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def preferences(changes: DataFrame) -> DataFrame:
    """``(user_id, item_id, value, revision)``: the last change of each user and item by ``revision``; value 0 deletes."""
    last = Window.partitionBy("user_id", "item_id").orderBy(F.desc("revision"))
    return changes.withColumn("n", F.row_number().over(last)).filter("n = 1 and value <> 0").drop("n")


def too_many(prefs: DataFrame, limit: int = 500) -> DataFrame:
    """Users over the limit of preferences."""
    return prefs.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def without_deleted(tables: dict[str, DataFrame], ledger: DataFrame, user_col: str = "user_id") -> dict[str, DataFrame]:
    """Every user table without the rows of users in the ``ledger``: account deletion, and its replay after a restore."""
    gone = ledger.select(user_col).distinct()
    return {k: t.join(gone, user_col, "left_anti") for k, t in tables.items()}


def exported(tables: dict[str, DataFrame], user, user_col: str = "user_id") -> DataFrame:
    """``(table, row)``: all rows of one user, as JSON."""
    parts = [t.filter(F.col(user_col) == user).select(F.lit(k).alias("table"), F.to_json(F.struct("*")).alias("row")) for k, t in sorted(tables.items())]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def write_bundle(parts: dict[str, DataFrame], path: str) -> None:
    """An immutable release: one folder per role, which must not be there yet, and a manifest with each file's SHA-256."""
    for role, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/{role}")
    spark = next(iter(parts.values())).sparkSession
    digests(spark, path, list(parts)).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def digests(spark: SparkSession, path: str, roles: list[str]) -> DataFrame:
    """``(role, file, sha256)`` of a bundle's data files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{path}/{r}" for r in roles])
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("role"), name.alias("file"), F.sha2("content", 256).alias("sha256"))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """Files that are missing, unlisted or changed against the manifest; empty for a sound bundle."""
    stated = spark.read.schema("role string, file string, sha256 string").json(f"{path}/manifest")
    roles = [r.role for r in stated.select("role").distinct().collect()]
    found = digests(spark, path, roles).withColumnRenamed("sha256", "now")
    both = stated.join(found, ["role", "file"], "full_outer")
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("role", "file", reason.alias("fault")).filter("fault is not null")
