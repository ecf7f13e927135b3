"""Sum-of-squares packing of tokenised documents into fixed-length sequences (operator 7)."""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import STEP_BYTES, materialize, steps, texts_of


def load_encoding(path: str, pattern: str):
    """The byte-level BPE vocabulary of a rank file, with the added tokens of the tokenizer's JSON beside it.

    An added token in a text is one id, as with `tokenizers`; all else is ordinary text.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(f"{os.path.splitext(path)[0]}.json", "rb") as f:
        added = json.load(f)["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
        raise ValueError("only added tokens that match literally are supported")
    return tiktoken.Encoding("marlstone", pat_str=pattern, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: whole sequences, and before them the rest, if any."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def tokenized_pieces(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id_col: str = "doc_id", length: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut at ``length``.

    A null text is the empty one, of one piece with the end id alone.  A very long text is one
    row of ids in memory at a time; ``keep_ids`` also returns the ids of each piece.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.uint32()))] * keep_ids
    out = pa.schema([(n, pa.list_(pa.int32()) if n == "ids" else t) for n, t in fields])

    def run(batches):
        encode = load_encoding(vocabulary, pattern).encode_to_numpy
        for b in batches:
            docs, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in steps(texts, STEP_BYTES):
                cols = defaultdict(list)
                for doc, t in zip(docs[lo:hi], texts[lo:hi], strict=True):
                    ids = np.append(encode(t, allowed_special="all"), end_id).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(ids), length)):
                        part = ids[s : s + n]
                        for name, x in zip(out.names, (doc, k, s, n, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                            cols[name].append(x)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ddl)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each size, in the order given; bins are numbered as they open.

    A size goes into the open bin where the sum of the squared counts of open bins per residual
    gap becomes smallest: a bin of gap g changes it by 2 * (N[g - s] - N[g]) + 2, and a bin that
    becomes full leaves it.  Ties go to the smaller gap.  A new bin opens only where none fits:
    with the largest sizes first, that needs about 1 % fewer bins than opening one whenever the
    sum would gain by it.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        if s >= capacity:
            bins[i], offsets[i] = opened, 0
            opened += 1
            continue
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        change[0] -= 2 * count[0] + 1  # the bin is full then and leaves the sum
        change[count[s:capacity] == 0] = np.iinfo(np.int64).max
        k = int(change.argmin())
        if count[s + k]:
            gap = s + k
            at = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, opened
            opened += 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > s:
            open_bins[gap - s].append(at)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 1024, block_rows: int = 65536) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each piece's place in a sequence of ``capacity`` ids.

    Pieces are dealt by hash into blocks of about ``block_rows``, and each block is packed on its
    own, largest first: memory and time of a task are bounded, whatever the input.  A block ends with
    a few sequences that are not full, of some ten thousands.  Equal inputs give equal packings.
    ``pieces(doc_id, piece, length, ...)`` is read twice: pass a written table.
    """
    total = pieces.count()
    blocks = max(1, -(-total // block_rows))
    salted = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.lit(blocks)).cast("int"))
    names = pieces.columns
    extra = [c for c in names if c not in ("doc_id", "piece", "length")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), *((c, "ascending") for c in extra if not pa.types.is_nested(group.schema.field(c).type))])
        bins, offsets = sum_of_squares(group.column("length").to_numpy(), capacity)
        return group.select(names).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 40))).append_column("offset", pa.array(offsets))

    return salted.groupBy("block").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id_col: str = "doc_id", length: int = 1024, end_id: int = 2, block_rows: int = 65536, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack the whole texts of ``df``; see ``tokenized_pieces`` and ``pack``.

    Repeated rows are packed as often as they come; a very long text is cut into whole sequences and a rest; a null doc_id is kept as null; an empty
    table gives no pieces; other columns are not read.
    """
    pieces, _ = materialize(tokenized_pieces(df, vocabulary, pattern, text, id_col, length, end_id, keep_ids), "pieces")
    return pack(pieces, length, block_rows)
