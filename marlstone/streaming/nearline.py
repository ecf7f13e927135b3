"""The nearline path: keyed feature state, sliding rates, a journal applied batch by batch, fenced publication, and the progress of a run."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators import journal
from marlstone.operators.tables import _at


class Changed(RuntimeError):
    """The generation moved during every attempt."""


def sliding_counts(stream: DataFrame, width: str = "60 seconds", step: str = "1 second", lateness: str | None = None) -> DataFrame:
    """``(item_id, window_start_ms, views, likes)`` of windows that begin every ``step``; each record counts in width / step of them."""
    rows = stream.withWatermark("ts", lateness) if lateness else stream
    sums = rows.groupBy(F.window("ts", width, step).alias("w"), "item_id").agg(F.count("*").alias("views"), F.sum(F.col("type").cast("long")).alias("likes"))
    return sums.select("item_id", F.unix_millis("w.start").alias("window_start_ms"), "views", "likes")


def item_state(stream: DataFrame) -> DataFrame:
    """``(item_id, views, likes, last_event_ms)`` in update mode: the last applied event is the one of the greatest ``event_id``."""
    last = F.max_by("event_time_ms", "event_id").alias("last_event_ms")
    return stream.groupBy("item_id").agg(F.count("*").alias("views"), F.sum(F.col("type").cast("long")).alias("likes"), last)


def user_state(stream: DataFrame, n: int = 8) -> DataFrame:
    """``(user_id, last_items, last_event_ms)`` in update mode: a user's last ``n`` items in order of ``event_id``.

    A state holds ``n`` events, whatever the user's rows; records that come late enough to be before all of them change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            kept += zip(b.event_id.tolist(), b.item_id.tolist(), b.event_time_ms.tolist(), strict=True)
            kept = sorted(set(kept))[-n:]
        ids, items, times = (list(x) for x in zip(*kept, strict=True))
        state.update((ids, items, times))
        yield pd.DataFrame({"user_id": [key[0]], "last_items": [items], "last_event_ms": [times[-1]]})

    rows = stream.select("user_id", "event_id", "item_id", "event_time_ms").dropna()
    kept = "ids array<long>, items array<long>, times array<long>"
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, last_items array<long>, last_event_ms long", kept, "update", GroupStateTimeout.NoTimeout)


def journal_applier(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that applies each batch of journal rows against what was accepted in earlier ones, as one pass over all would.

    Rows arrive in order of ``seq`` from batch to batch.  Of the accepted history a batch needs only the rows under its event ids, and
    all rows of the requests and items that these or its own rows are about; accepted rows applied again are accepted again.
    A batch that runs again replaces its own folder and reads only earlier ones.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        key = ["request_id", "item_id"] if "request_id" in batch.columns else ["user_id", "item_id"]
        old = _before(spark, path, number, batch)
        rows = batch
        if old is not None:
            taken = old.filter("status = 'accepted'").select(*batch.columns)
            keys = batch.select(*key).unionByName(taken.join(batch.select("event_id"), "event_id", "left_semi").select(*key)).distinct()
            rows = taken.join(keys, key, "left_semi").unionByName(batch)
        found = journal.accepted(rows).join(batch.select("seq"), "seq", "left_semi")
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def _before(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame | None:
    fs, p = _at(spark, path)
    if number == 0 or not fs.exists(p):
        return None
    return spark.read.schema(applied_schema(like)).option("basePath", path).parquet(path).filter(F.col("batch") < number)


def applied_schema(like: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields) + ", status string, batch int"


def applied(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``journal_applier`` has decided, with their status."""
    return spark.read.parquet(path).drop("batch")


def generation(spark: SparkSession, path: str) -> int:
    """The newest whole generation under ``path``; 0 where there is none."""
    fs, p = _at(spark, f"{path}/_named")
    if not fs.exists(p):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest generation."""
    return spark.read.parquet(f"{path}/generation={generation(spark, path)}")


def publish(df: DataFrame, path: str, expected: int) -> bool:
    """Write ``df`` as the generation after ``expected`` and name it, unless another was named since; whether it was.

    The rows go to a folder of their own first; the name is a file made only if it is not there, so of two writers one wins, and readers
    see a generation whole or not at all.
    """
    spark = df.sparkSession
    if generation(spark, path) != expected:
        return False
    import uuid

    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, name = _at(spark, f"{path}/_named/{expected + 1}")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation={expected + 1}")
    source = spark._jvm.org.apache.hadoop.fs.Path(staged)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        return False
    try:
        fs.create(name, False).close()
    except Exception:  # another writer named it first
        return False
    return True


def fenced(spark: SparkSession, path: str, compute: Callable[[int], DataFrame], attempts: int = 3) -> int:
    """Publish what ``compute(generation)`` gives, anew if the generation moves meanwhile, ``attempts`` times at most; the new generation."""
    for _ in range(attempts):
        seen = generation(spark, path)
        if publish(compute(seen), path, seen):
            return seen + 1
    raise Changed(f"{path} changed during {attempts} attempts")


def progress(reports: list) -> list[dict]:
    """Per report and source: rows consumed, rows and batches since the start, lag, and the watermark's time, apart from each other.

    ``lag`` is the sum over partitions of latest less end offset, 0 at least, where a source names both as numbers by partition; null for
    sources that do not (files).
    """
    out, consumed = [], 0
    for r in reports:
        r = r if isinstance(r, dict) else json.loads(r.json)
        for s in r["sources"]:
            consumed += s["numInputRows"]
            out.append({"batch": r["batchId"], "source": s["description"], "rows": s["numInputRows"], "consumed": consumed, "lag": _lag(s.get("latestOffset"), s.get("endOffset")), "watermark": r.get("eventTime", {}).get("watermark")})
    return out


def _lag(latest, end) -> int | None:
    latest, end = (ast.literal_eval(x) if isinstance(x, str) and x.startswith("{") else x for x in (latest, end))  # offsets come as text of a dict
    numbers = lambda d: {(t, p): n for t, parts in d.items() if isinstance(parts, dict) for p, n in parts.items()} if isinstance(d, dict) else {}
    high, at = numbers(latest), numbers(end)
    return sum(max(0, n - at.get(k, 0)) for k, n in high.items()) if high else None


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None):
    """Run ``stream`` into ``sink``: to its present end and no further, or with ``every`` (\"5 seconds\") at that interval until stopped.

    At the end everything read is published, so nothing staged is lost.  Returns the query, ended or running.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    if every:
        return writer.trigger(processingTime=every).start()
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    return run
