"""Count tables of fixed size, gathered over a whole corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import fold_of, materialize

#: Rows of a table that travel and are summed together.
CHUNK = 1 << 12
#: Parts of a chunk that are merged in one group at most.
FAN = 64
_SCHEMA = "name string, chunk int, at binary, value binary"
_ARROW = pa.schema([("name", pa.string()), ("chunk", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])


_MERGE = {"add": np.add, "or": np.bitwise_or, "max": np.maximum}


class Spec:
    """A table's shape and type, and how two parts of it become one."""

    def __init__(self, shape: tuple[int, ...], dtype: str = "int64", merge: str = "add"):
        self.shape, self.dtype, self.merge = shape, np.dtype(dtype), merge

    def new(self) -> np.ndarray:
        return np.zeros(self.shape, dtype=self.dtype)


def _sparse(name: str, table: np.ndarray) -> Iterator[tuple]:
    flat = table.reshape(len(table), -1)
    for k in range(0, len(flat), CHUNK):
        part = flat[k : k + CHUNK]
        at = np.nonzero(part.any(axis=1))[0]
        if len(at):
            value = part[at]
            small = value.dtype == np.int64 and np.abs(value).max() < 1 << 31
            yield name, k // CHUNK, at.astype("<u2").tobytes(), (value.astype(np.int32) if small else value).tobytes()


def _values(raw: bytes, rows: int, width: int, dtype: np.dtype) -> np.ndarray:
    """What ``_sparse`` wrote: small 64-bit integers travel as 32-bit ones."""
    return np.frombuffer(raw, np.int32 if dtype == np.int64 and len(raw) == 4 * rows * width else dtype).reshape(rows, width)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def gather(df: DataFrame, specs: dict[str, Spec], count: Callable[[dict[str, np.ndarray], pa.RecordBatch], None]) -> dict[str, np.ndarray]:
    """The tables of ``specs`` over all rows of ``df``: ``count(tables, batch)`` adds a batch's share.

    Each task sums into tables of its own and sends on only the rows it touched; chunks of tables are
    merged by key on the executors.  What reaches the driver has the fixed size of the
    tables, whatever the corpus.  Sums of integers and bit unions do not depend on order.
    """

    def run(batches):
        tables = {k: s.new() for k, s in specs.items()}
        for b in batches:
            count(tables, b)
        for name, t in tables.items():
            for row in _sparse(name, t):
                yield _batch([row])

    def merge(key, group):
        name, chunk = key[0].as_py(), key[1].as_py()
        spec = specs[name]
        width = int(np.prod(spec.shape[1:], dtype=int))
        whole = np.zeros((CHUNK, width), dtype=spec.dtype)
        for at, value in zip(group.column("at").to_pylist(), group.column("value").to_pylist(), strict=True):
            i = np.frombuffer(at, "<u2")
            v = _values(value, len(i), width, spec.dtype)
            whole[i] = _MERGE[spec.merge](whole[i], v)
        return pa.Table.from_batches([_batch([(name, chunk, *row[2:])]) for row in _sparse(name, whole)], schema=_ARROW)

    def merge_level(key, group):
        one = merge(key, group)
        return one.append_column("task", pa.array([key[2].as_py()] * one.num_rows, pa.int32()))

    # the parts are written first: adaptive execution may not join the few large groups into one task
    parts, _ = materialize(df.mapInArrow(run, _SCHEMA).withColumn("task", F.spark_partition_id()), "tables")
    found = {k: s.new() for k, s in specs.items()}
    # at most FAN rows of a chunk meet in a group, level by level, however many tasks there were
    tasks, width, merged = (parts.agg(F.max("task")).first()[0] or 0) + 1, FAN, parts
    while width < tasks:
        level = merged.withColumn("task", F.floor(F.col("task") / FAN).cast("int"))
        merged = level.groupBy("name", "chunk", "task").applyInArrow(merge_level, _SCHEMA + ", task int")
        width *= FAN
    merged = merged.groupBy("name", "chunk").applyInArrow(merge, _SCHEMA)
    for r in merged.toLocalIterator():
        flat = found[r["name"]].reshape(len(found[r["name"]]), -1)
        i = np.frombuffer(r["at"], "<u2").astype(np.int64) + r["chunk"] * CHUNK
        flat[i] = _values(r["value"], len(i), flat.shape[1], flat.dtype)
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str, id_col: str, most: int, balanced: bool = False) -> DataFrame:
    """``(doc_id, text, y, fold)``: at most ``most`` labelled rows outside fold 0, the same ones every time.

    Rows come in order of a hash of their id.  ``balanced``: up to half of them are of the rarer
    class.  The sample is bounded, so its ids are broadcast; a doc_id with two labels is left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("id", "y", fold_of(F.col("id")).alias("fold")).filter("fold <> 0")
    order = [F.xxhash64("id"), F.col("id")]
    if balanced:
        sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
        rare = min((0, 1), key=lambda y: sizes.get(y, 0))
        n = min(most // 2, sizes.get(rare, 0))
        chosen = known.filter(F.col("y") == rare).orderBy(*order).limit(n).unionByName(known.filter(F.col("y") != rare).orderBy(*order).limit(most - n))
    else:
        chosen = known.orderBy(*order).limit(most)
    chosen, _ = materialize(chosen, "labelled")
    met = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return materialize(met.select(F.col("id").alias("doc_id"), "text", "y", "fold"), "labelled-texts")[0]
