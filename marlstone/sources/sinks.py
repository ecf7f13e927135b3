"""Writers: feature files, windowed rows, binary catalogs, pairs and a training export with its manifest."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources import event17, matrices


def write_windows(windows: DataFrame, path: str) -> None:
    """Rows ``item, window start, views, likes`` without a header, many files; what was there is replaced."""
    windows.select("item_id", "window_start_ms", "views", "likes").write.mode("overwrite").csv(path, header=False)


def write_features(features: DataFrame, path: str, files: int = 1) -> None:
    """``item,views,likes,ctr`` of items with views, in order of the item, rates with 9 places.

    One file, as its readers expect, has one row per item; ``files`` > 1 keeps the order over several, by ranges of items.
    """
    rows = features.filter("views > 0").select(F.col("item_id").alias("item"), "views", "likes", F.format_string("%.9f", F.col("ctr").cast("double")).alias("ctr"))
    rows.repartitionByRange(files, "item").sortWithinPartitions("item").write.mode("overwrite").csv(path, header=True)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item long, views long, likes long, ctr double").csv(path, header=True)


def write_events(events: DataFrame, path: str) -> None:
    """Packed records of 17 bytes, in order of event_id within each file, as rows of one binary column."""
    event17.encode(events).sortWithinPartitions("event_id").select("payload").write.mode("overwrite").parquet(path)


def write_matrix(vectors: DataFrame, path: str, magic: int) -> None:
    """A binary matrix per part: magic, rows, columns, then little-endian floats by row; ids run on from part to part in the order of the names.

    ``vectors(item_id, embedding)`` are dealt by ranges of the id, so each part is a catalog of its own and no task holds the whole.
    """

    def run(batches):
        rows, dim = [], 0
        for b in batches:
            if b.num_rows:
                m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1)
                dim = m.shape[1]
                rows.append(m)
        if rows:
            body = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<Iii", magic, len(body), dim) + body.tobytes()], pa.binary())], names=["content"])

    parts = vectors.select("item_id", "embedding").repartitionByRange("item_id").sortWithinPartitions("item_id")
    parts.mapInArrow(run, "content binary").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, magic: int) -> DataFrame:
    """``(part, row, embedding)`` of what ``write_matrix`` wrote; a damaged part raises."""

    def run(batches):
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = matrices.parse(raw, magic)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(m)), pa.array(range(len(m)), pa.int32()), pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))], names=["part", "row", "embedding"])

    files = spark.read.parquet(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"), "content")
    return files.mapInArrow(run, "part string, row int, embedding array<float>")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``(query_row, items)`` of a CSV of pairs: the different items of each query."""
    pairs = spark.read.schema("query_row long, item long").csv(path, header=True, mode="DROPMALFORMED")
    return pairs.groupBy("query_row").agg(F.array_sort(F.collect_set("item")).alias("items"))


def write_training(factors: dict[str, DataFrame], train: DataFrame, test: DataFrame, path: str) -> None:
    """A training export: factors by role, train and test pairs, dense ids of users and items, and a manifest of SHA-256 by file."""
    from marlstone.operators.accounts import write_bundle
    from marlstone.operators.tables import numbered

    maps = {f"{c}_map": numbered(train.select(c).unionByName(test.select(c)).distinct(), "row", c).withColumn("row", F.col("row") - 1) for c in ("user", "item")}
    write_bundle({**factors, "train": train.select("user", "item"), "test": test.select("user", "item"), **maps}, path)


def lag(offsets: DataFrame) -> DataFrame:
    """``offsets(partition, high, last)`` with ``lag``: records behind the end, 0 at least; null where the end is not known."""
    return offsets.withColumn("lag", F.when(F.col("high").isNotNull(), F.greatest(F.lit(0), F.col("high") - (F.coalesce("last", F.lit(-1)) + 1))))


def scraped(spark: SparkSession, path: str) -> DataFrame:
    """``(name, value)`` of a metrics text: name and number by line; comments and other lines are left out."""
    lines = spark.read.text(path).filter("value not like '#%'")
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(F.element_at(parts, 1).alias("name"), F.try_to_number(F.element_at(parts, -1), F.lit("S999999999999999999")).cast("long").alias("value"), F.size(parts).alias("n")).filter("n = 2 and value is not null").drop("n")
