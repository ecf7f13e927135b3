"""SimHash fingerprints and near-duplicate components (operator 3)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from marlstone.llm.common import materialize
from marlstone.llm.components import connected_components


def _fingerprint(text: bytes, words: int, seed: int) -> int:
    w = text.lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, *carry)``: one row per row of ``df``; ``fp`` is the 64-bit SimHash as a signed long.

    Words are runs of anything but ASCII white space after lowering A-Z; a shingle is ``words``
    of them, repeats included; fewer words make one shingle; no words (null too) give 0.
    A bit is set if it is set in over half of the shingle hashes (XXH64).
    ``carry`` names columns of longs that are kept.
    """
    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *carry)])

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array([_fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *(b.column(c) for c in carry)], schema=out)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carry).mapInArrow(run, ", ".join(f"{c} long" for c in out.names))


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Array of keys, one per choice of ``blocks - distance`` blocks: two fingerprints within ``distance`` share one at least."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << edges[c + 1]) - 1) ^ ((1 << edges[c]) - 1) for c in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _links(own: np.ndarray, other: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``own``, or of those between ``own`` and ``other``, as positions.

    Work goes by rows of a matrix of distances, a block at a time; only joins of two trees are kept.
    """
    n = len(own)
    nodes = own if other is None else np.concatenate([own, other])
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in range(n):
        lo = i + 1 if other is None else n
        near = np.nonzero(np.bitwise_count(nodes[lo:] ^ nodes[i]) <= distance)[0]
        for j in near.tolist():
            a, b = root(i), root(lo + j)
            if a != b:
                parent[a] = b
                found.append((i, lo + j))
    return found


def near_links(reps: DataFrame, distance: int = 3, blocks: int = 5, tile: int = 2048) -> DataFrame:
    """``(a, b)``: enough links to connect all fingerprints of ``reps(rep, fp)`` within ``distance`` bits.

    Pigeonhole: of ``blocks`` blocks at most ``distance`` differ, so close pairs agree on some
    choice of the others.  Fingerprints are joined on these choices, then the distance is verified.
    A bucket of more than ``tile`` fingerprints is dealt over tiles, and each pair of its tiles is
    a group of its own: no group has over about ``2 * tile`` rows, and none is dropped or capped.
    Groups give a spanning forest of their links, never all pairs.
    """
    keys = reps.select("rep", "fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("key")).select("rep", "fp", "key.k", "key.bits")
    sizes = keys.groupBy("k", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(11)), tiles).cast("int")
    cells = F.transform(F.sequence(F.lit(0), tiles - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), (j != mine).alias("cross"), (mine <= j).alias("own")))
    dealt = keys.join(sizes, ["k", "bits"]).select("rep", "fp", "k", "bits", F.explode(cells).alias("c"))
    groups = dealt.groupBy("k", "bits", "c.i", "c.j").agg(F.collect_list(F.struct("rep", "fp", F.col("c.own").alias("own"))).alias("m"), F.first("c.cross").alias("cross"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members, cross in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                flat = members.values
                rep = flat.field("rep").to_numpy()
                fp = flat.field("fp").to_numpy().view(np.uint64)
                if cross:
                    own = flat.field("own").to_numpy(zero_copy_only=False)
                    order = np.concatenate([np.nonzero(own)[0], np.nonzero(~own)[0]])
                    k = int(own.sum())
                    found = _links(fp[order][:k], fp[order][k:], distance)
                    rep = rep[order]
                else:
                    found = _links(fp, None, distance)
                for i, j in found:
                    a.append(rep[i])
                    b.append(rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return groups.select("m", "cross").mapInArrow(run, "a long, b long").distinct()


def _by_fingerprint(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``(fp, least, c)`` for every fingerprint of ``fps``: the smallest doc_id that has it, and its component."""
    # fingerprints of rows without an id still carry links: such a node has an id below all others
    reps, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("rep"), "fp", "least"), "simhash-reps")
    parts = connected_components(near_links(reps, distance, blocks))
    return reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("c"))


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, distance: int = 3, blocks: int = 5, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per row of ``df``.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the smallest
    doc_id reachable, itself included.  Equal texts meet as one fingerprint, so large groups of
    copies are one node.  Null texts and texts without words have fingerprint zero and link like
    any other; a very long text is hashed whole, in parts; repeated rows give repeated rows; an empty table gives an empty result; a null doc_id keeps its row, and its component
    is the smallest doc_id reached, or null where there is none.  Other columns are not read.
    """
    fps, _ = materialize(fingerprints(df, text, id_col, words, seed), "simhash")
    by_fp = _by_fingerprint(fps, distance, blocks)
    least = by_fp.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = by_fp.join(least, "c").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of hash over all columns of a row; a null differs from every value."""
    flat = [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema]
    return F.xxhash64(F.lit(seed), *(x for c in flat for x in (c, c.isNull())))


def keep_one(df: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = 3, distance: int = 3, blocks: int = 5, seed: int = 42) -> DataFrame:
    """The rows of ``df`` without near copies: of each component one row stays, whatever the other components hold.

    It is one with the smallest doc_id; a row with a null doc_id stays only where its component has no
    doc_id at all.  Among several such rows a hash of the whole row decides, so a retry chooses the same one;
    rows that are equal in all columns (by 128 bits of hash) count as one.
    """
    keys = [_row_hash(df, 1).alias("h1"), _row_hash(df, 2).alias("h2")]
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), *keys)
    fps, _ = materialize(fingerprints(narrow, "text", "doc_id", words, seed, ("h1", "h2")), "simhash")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h1", "h2")
    keep = fps.join(_by_fingerprint(fps, distance, blocks), "fp").groupBy("c").agg(F.min(order).alias("m")).select("m.h1", "m.h2")
    rows = df.select(F.struct("*").alias("row"), *keys)
    return rows.join(keep, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")
