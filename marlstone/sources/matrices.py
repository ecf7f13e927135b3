"""Dense matrix files: a magic number, the shape, and 32-bit floats, all little-endian."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the formats.
CATALOG_MAGIC, QUERY_MAGIC = 0x43415431, 0x51525931
MOST_ROWS, MOST_DIMS = 100_000_000, 4096


def parse(data: bytes, magic: int) -> np.ndarray:
    """The matrix of a whole file; anything that does not fit is an error."""
    if len(data) < 12:
        raise ValueError("the file is shorter than its header")
    found, n, dim = struct.unpack("<Iii", data[:12])
    if found != magic:
        raise ValueError(f"magic number {found:#x}, not {magic:#x}")
    if not (0 < n <= MOST_ROWS and 0 < dim <= MOST_DIMS):
        raise ValueError(f"shape {n} x {dim} is out of bounds")
    if len(data) != 12 + 4 * n * dim:
        raise ValueError("the length does not match the shape")
    m = np.frombuffer(data, "<f4", offset=12).reshape(n, dim)
    if not np.isfinite(m).all():
        raise ValueError("an element is not finite")
    return m


def read(spark: SparkSession, path: str, magic: int = CATALOG_MAGIC, id_col: str = "item_id") -> DataFrame:
    """``(item_id, embedding)``: rows of a file are numbered from 0."""

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                m = parse(raw.as_py(), magic)
                for lo in range(0, len(m), 4096):
                    part = m[lo : lo + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), values], names=[id_col, "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"{id_col} long, embedding array<float>")
