"""Files of a layered neighbour graph: written, read and checked whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the format: magic, then rows, dimension, m, links above and on the ground layer, top level, entry, as little-endian 32-bit numbers
MAGIC = 0x48535732
HEADER = ("n", "dim", "m", "most", "most_ground", "top", "entry")
DEEPEST = 64
NODES = "node int, level int, layers array<array<int>>"


def pack(layers: list[list[list[int]]], dim: int, m: int, entry: int) -> bytes:
    """``layers[node][layer]``: the links of each node; the ground layer holds up to 2 m of them, the others m."""
    n, level = len(layers), np.array([len(x) - 1 for x in layers], "<i4")
    table = lambda lists, width: (np.array([len(x) for x in lists], "<u4"), np.array([x + [0] * (width - len(x)) for x in lists], "<u4").reshape(len(lists), width))
    degree, links = table([x[0] for x in layers], 2 * m)
    head = np.array([MAGIC, n, dim, m, m, 2 * m, int(level.max()), entry], "<u4")
    upper = (a.tobytes() for x in layers if len(x) > 1 for a in table(x[1:], m))
    return b"".join([head.tobytes(), degree.tobytes(), links.tobytes(), level.tobytes(), *upper])


def parse(data: bytes) -> tuple[dict[str, int], list[list[list[int]]]]:
    """Header and ``layers[node][layer]``; ``ValueError`` unless sizes, degrees, levels, links and the end of the file all hold."""
    raw, at = np.frombuffer(data[: len(data) // 4 * 4], "<u4"), 8

    def take(count: int) -> np.ndarray:
        nonlocal at
        if count < 0 or at + count > len(raw):
            raise ValueError("graph file ends early")
        at += count
        return raw[at - count : at]

    if len(data) % 4 or len(raw) < at or raw[0] != MAGIC:
        raise ValueError("no graph file")
    head = dict(zip(HEADER, raw[1:8].view("<i4").tolist(), strict=True))
    n, most, ground, top = head["n"], head["most"], head["most_ground"], head["top"]
    if min(n, head["dim"], head["m"], most, ground) < 1 or not 0 <= top <= DEEPEST or not 0 <= head["entry"] < n:
        raise ValueError("graph header out of range")
    degree, links, level = take(n), take(n * ground).reshape(n, ground), take(n).view("<i4")
    if (degree > ground).any() or (level < 0).any() or (level > top).any() or level[head["entry"]] != top:
        raise ValueError("graph degree or level out of range")
    layers = [[links[i, :d].tolist()] for i, d in enumerate(degree.tolist())]
    for i in np.flatnonzero(level):
        counts, upper = take(level[i]), take(level[i] * most).reshape(level[i], most)
        if (counts > most).any():
            raise ValueError("graph degree out of range")
        layers[i] += [row[:d].tolist() for row, d in zip(upper, counts.tolist(), strict=True)]
    if at != len(raw):
        raise ValueError("graph file has more after its end")
    for x in layers:
        for layer, ids in enumerate(x):
            if ids and (max(ids) >= n or (layer and (level[ids] < layer).any())):
                raise ValueError("graph link out of its layer")
    return head, layers


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(part, node, level, layers)`` of graph files, one task a file; a damaged file raises."""

    def run(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, layers = parse(data)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(layers)), pa.array(range(len(layers)), pa.int32()), pa.array([len(x) - 1 for x in layers], pa.int32()), pa.array(layers, pa.list_(pa.list_(pa.int32())))], names=["part", "node", "level", "layers"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"part string, {NODES}")
