"""Written tables: a step whose result is read more than once is written to the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session on one machine that names none gets a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path; it goes when the session ends, or earlier through ``remove``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... in the given order, which must be total.

    Rows are sorted by range partitions; what each task counts is added up on the driver, one number a partition, so no task sorts all rows.
    """
    spark = df.sparkSession
    low = (1 << 33) - 1  # of an id that grows within a partition, and whose upper bits are the partition
    placed, _ = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.call_function("shiftright", F.col("_id"), F.lit(33)).alias("_part")
    sizes = sorted(tuple(r) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    known = spark.createDataFrame(offsets, "_part long, _before long")
    met = placed.withColumn("_part", part).join(F.broadcast(known), "_part")
    return met.select(*df.columns, (F.col("_id").bitwiseAND(F.lit(low)) + F.col("_before") + 1).alias(name))
