"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Odd rows, stage by stage.  A null or empty text fails the quality rules.  A very long text is one row and is read whole by each stage.
Rows that repeat a document go with it through quality rules and line dedup (where they get the same decision) and are one row
after near dedup.  Different texts under one doc_id are rows of their own.  A null doc_id comes first in line
dedup, stays in near dedup only where its group has no other id, and is packed as null.  An empty table gives an empty table.
Columns of any other name are carried along unread; all but the last stage return the columns of their input, in order.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialize, table, tracked
from marlstone.llm.decontam import decontaminate
from marlstone.llm.line_dedup import dedup_lines
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality_rules import judge
from marlstone.llm.simhash import keep_one


_before: list[str] = []


def _stage(work):
    """The stage function ``work``; files that only the stage before it needed go when it begins, unless ``docs`` still reads them."""

    @functools.wraps(work)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _before else []
        for path in [p for p in _before if not any(p.rsplit("/", 1)[-1] in f for f in read)]:
            _before.remove(path)
            discard(spark, path)
        with tracked() as written:
            out = work(spark, docs, sf_dir)
        _before.extend(written)
        return out

    return run_one


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return judge(docs).filter("kept").select("row.*")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; the documents stay, with n_chars of what is left."""
    found = dedup_lines(docs)
    changed = F.size("removed") > 0
    cols = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("row.n_chars"))
    return found.select(*(cols.get(f.name, F.col("row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select("row.*")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The stages estimate rule accuracies and run a byte-level BPE, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it; what only a finished stage needed goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            discard(spark, before)
        before = path
    return docs
