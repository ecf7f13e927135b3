"""Benchmark decontamination by broadcast n-gram windows (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import as_row, materialize, steps

#: Fixed: word bytes are a-z (after lowering A-Z), 0-9 and every non-ASCII byte; all else separates.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` ids."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = h * _MIX + ids[k : k + len(h)]
        h ^= h >> np.uint64(29)
    return h


class _Windows:
    """All windows of some benchmark items: sorted hashes per length, with the exact ids behind each."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set[int]]] = {}
        for item, text in items:
            w = normal_words(text)
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.by_size = {}
        for size, windows in found.items():
            exact: dict[int, list[tuple[tuple, list[int]]]] = {}
            for ids, owners in windows.items():
                exact.setdefault(int(_rolling(np.array(ids, dtype=np.uint64), size)[0]), []).append((ids, sorted(owners)))
            self.by_size[size] = (np.array(sorted(exact), dtype=np.uint64), exact)

    def scan(self, ids: np.ndarray):
        """``(start, size, owners)`` of every verified occurrence in ``ids``; id 0 is a word of no item."""
        for size, (hashes, exact) in self.by_size.items():
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.nonzero(known[size:] - known[:-size] == size)[0] if len(ids) >= size else np.empty(0, dtype=np.int64)
            if not len(at):
                continue
            h = _rolling(ids, size)[at]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i, x in zip(at[hashes[k] == h].tolist(), h[hashes[k] == h].tolist(), strict=True):
                window = tuple(ids[i : i + size].tolist())
                for own, owners in exact[x]:
                    if own == window:
                        yield i, size, owners


_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("owners", T.ArrayType(T.ArrayType(T.LongType()))),
]


def _scan(rows: DataFrame, windows_of, row_type: T.DataType) -> DataFrame:
    """``rows(row, text)`` to ``(row, n_words, starts, sizes, owners)``: the occurrences in each whole text."""
    schema = T.StructType([T.StructField("row", row_type)] + _FOUND)

    def run(batches):
        windows = windows_of()
        get = windows.vocabulary.get
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in steps(texts):
                flat: list[int] = []
                ends = []
                for t in texts[lo:hi]:
                    flat += [get(w, 0) for w in normal_words(t)]
                    ends.append(len(flat))
                    flat.append(0)  # no window runs over the end of a text
                ids = np.array(flat, dtype=np.uint64)
                ends_at = np.array(ends)
                begins = np.concatenate([[0], ends_at[:-1] + 1])
                hits: list[tuple[list, list, list]] = [([], [], []) for _ in ends]
                for i, size, owners in windows.scan(ids):
                    d = int(np.searchsorted(ends_at, i, side="right"))
                    for to, x in zip(hits[d], (i - int(begins[d]), size, owners), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(ends_at - begins, pa.int64()), pa.array([h[0] for h in hits], pa.list_(pa.int64())), pa.array([h[1] for h in hits], pa.list_(pa.int32())), pa.array([h[2] for h in hits], pa.list_(pa.list_(pa.int64())))],
                    names=["row", "n_words", "starts", "sizes", "owners"],
                )

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, part_bytes: int = 32 << 20) -> DataFrame:
    """``(row, n_words, n_hit, n_items, items, items_sha256, contaminated, spans)`` for every row of ``docs``.

    Words: A-Z lowered, runs of a-z, 0-9 and non-ASCII characters.  A window: ``window`` words in
    a row of an item; an item of fewer, but not none, is one window.  A document word inside any
    occurrence is hit; ``contaminated``: n_hit > 0 and ``share`` * n_hit >= n_words.
    ``row`` is the whole input row as a struct, so no column of ``docs`` can clash;
    ``spans`` are the hit word ranges (first, last + 1), for removal in place of dropping.

    The windows are broadcast in parts of at most ``part_bytes`` of item text: the benchmark is
    measured first, and a larger one is scanned part by part, the occurrences then meet per row.
    (A single item longer than that is cut into parts that overlap by ``window`` - 1 words.)
    Null texts have no words; null items and items without words have no windows; items with a
    null id are left out; an empty benchmark leaves every document clean.  A very long text is scanned whole; repeated
    rows get the same verdict and each is returned; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = as_row(docs).withColumn("text", F.col("row").getField(text).cast("string"))
    row_type = rows.schema["row"].dataType
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("t")).filter("item is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= part_bytes:
        held = spark.sparkContext.broadcast([(r.item, r.t.encode()) for r in items.collect()])
        found = _scan(rows.select("row", "text"), lambda: _Windows(held.value, window), row_type)
        return _verdicts(found, share)
    parts = -(-total // part_bytes)
    keyed = rows.withColumn("key", F.monotonically_increasing_id())
    keyed, _ = materialize(keyed, "decontam-rows")
    pieces, _ = materialize(_pieces(items, window, part_bytes // 4).withColumn("part", F.pmod(F.xxhash64("item", "p"), F.lit(2 * parts))), "decontam-items")
    scans = []
    for k in range(2 * parts):
        held = spark.sparkContext.broadcast([(r.item, r.t.encode()) for r in pieces.filter(F.col("part") == k).collect()])
        slim = keyed.select(F.struct("key").alias("row"), "text")
        scans.append(_scan(slim, lambda held=held: _Windows(held.value, window), slim.schema["row"].dataType).filter("size(starts) > 0").select("row.key", F.explode(F.arrays_zip("starts", "sizes", "owners")).alias("x")))
    met = scans[0]
    for s in scans[1:]:
        met = met.unionByName(s)
    met = met.groupBy("key").agg(F.collect_list("x.starts").alias("starts"), F.collect_list("x.sizes").alias("sizes"), F.collect_list("x.owners").alias("owners"))
    counted = _scan(keyed.select(F.struct("key", "row").alias("row"), "text"), lambda: _Windows([], window), T.StructType([T.StructField("key", T.LongType()), T.StructField("row", row_type)]))
    counted = counted.select("row.key", F.col("row.row").alias("row"), "n_words")
    both = counted.join(met, "key", "left").select("row", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("starts", "array<long>"), ("sizes", "array<int>"), ("owners", "array<array<long>>"))))
    return _verdicts(both, share)


def _pieces(items: DataFrame, window: int, limit: int) -> DataFrame:
    """Items longer than ``limit`` bytes as overlapping pieces ``(item, p, t)``, so that every window is in one of them."""
    out = pa.schema([("item", pa.int64()), ("p", pa.int32()), ("t", pa.string())])

    def run(batches):
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = normal_words(t.encode())
                size, starts = 0, [0]
                for i, x in enumerate(w):
                    size += len(x) + 1
                    if size > limit:
                        starts.append(i)
                        size = 0
                cut = [(s, min(len(w), e + window - 1)) for s, e in zip(starts, [*starts[1:], len(w)], strict=True)]
                cut = [(s, e) for s, e in cut if len(w) <= window or e - s >= window]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([b" ".join(w[s:e]).decode() for s, e in cut], pa.string())], schema=out)

    return items.mapInArrow(run, "item long, p int, t string")


def _verdicts(found: DataFrame, share: int) -> DataFrame:
    spans = F.array_sort(F.arrays_zip("starts", "sizes"))
    none = F.array().cast("array<struct<s:long,e:long>>")
    # merge overlapping occurrences, in order of their starts
    merged = F.aggregate(
        spans,
        none,
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["starts"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["starts"] + x["sizes"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["starts"].alias("s"), (x["starts"] + x["sizes"]).alias("e"))))),
    )
    hit = F.size("starts") > 0
    named = found.select("row", "n_words", F.when(hit, merged).otherwise(none).alias("spans"), F.when(hit, F.array_distinct(F.flatten("owners"))).otherwise(F.array().cast("array<long>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    counted = named.select("row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join(F.sort_array(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"), "spans")
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
