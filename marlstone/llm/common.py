"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a character class for Java's regex: a word is a run of anything else.
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
#: Bytes of text that one vectorised step works on at most (a single longer text is a step of its own).
STEP_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a session on one machine (tests) that names none gets a new local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared scratch folder and read it back: its lineage is cut there.

    Only committed files are read, so a lost executor never changes what later steps see.
    The folder goes when the session ends, or earlier through ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    if was is not None:  # shuffle files of this step go as it ends: its result is in the folder
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if was is not None:
            spark.conf.set(_CLEANUP, was)
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


_written: list[list[str]] = []


@contextlib.contextmanager
def tracked() -> Iterator[list[str]]:
    """The folders that ``materialize`` writes inside."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        _written.pop()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing will read again."""
    fs, p = _fs_path(spark, path)
    fs.delete(p, True)


def written_bytes(df: DataFrame) -> int:
    """The size of the table ``df``, as ``materialize`` wrote it."""
    files = df.inputFiles()
    if not files:
        return 0
    fs, p = _fs_path(df.sparkSession, files[0])
    return fs.getContentSummary(p.getParent()).getLength()


def sized(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """The written table ``df``, marked for broadcast if its files hold at most ``most_bytes``; else joins on it go by key."""
    return F.broadcast(df) if written_bytes(df) <= most_bytes else df


def as_row(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``row``: no added column can clash with them."""
    return df.select(F.struct("*").alias("row"))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; fold 0 is held out.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def steps(texts: list, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (bytes or str) with about ``limit`` of length each; always at least one text."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        n = len(x) + 1
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def texts_of(column) -> list[str]:
    """An Arrow text column as Python strings; null gives the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def with_columns(batch, names: list[str], schema: pa.Schema, **new) -> pa.RecordBatch:
    """A batch of ``schema``: the kept columns ``names`` of ``batch`` and the ``new`` arrays."""
    cols = [batch.column(n) for n in names] + [new[f.name] for f in schema if f.name in new]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema, strict=True)], schema=schema)
