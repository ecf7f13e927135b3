"""Click-through features of items and users: totals, windows, histories, publication skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as a double, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b).cast("double"), F.lit(0.0))


def _counted(groups) -> DataFrame:
    return groups.agg(F.count("*").alias("views"), F.sum(F.col("type").cast("long")).alias("likes"))


def item_ctr(events: DataFrame, until_ms: int | None = None) -> DataFrame:
    """Every event is a view, type 1 a like too; ``until_ms`` is inclusive."""
    chosen = events if until_ms is None else events.filter(F.col("event_time_ms") <= until_ms)
    return _counted(chosen.groupBy("item_id")).withColumn("ctr", ratio("likes", "views"))


def tumbling_ctr(events: DataFrame, width_ms: int) -> DataFrame:
    start = F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(width_ms))
    return _counted(events.groupBy("item_id", start.alias("window_start_ms"))).withColumn("ctr", ratio("likes", "views"))


def rolled_up(windows: DataFrame) -> DataFrame:
    return windows.groupBy("item_id").agg(F.sum("views").alias("views"), F.sum("likes").alias("likes"))


def audit(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: keys of one side only, keys whose values differ, keys in all.  No tolerance."""
    a = left.select(key, F.struct(*values).alias("a"))
    b = right.select(key, F.struct(*values).alias("b"))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.expr("b is null")).alias("only_left"), F.count_if(F.expr("a is null")).alias("only_right"), F.count_if(F.expr("a is not null and b is not null and not (a <=> b)")).alias("mismatched"), F.count("*").alias("total"))


def sliding_ctr(events: DataFrame, bucket_ms: int, buckets: int) -> DataFrame:
    """Per item and bucket with events: counts of this bucket and of the ``buckets`` before it.

    Events are summed per bucket first, so the window works on buckets, not on events; a late event
    counts in its own bucket and none is lost.
    """
    sums = _counted(events.groupBy("item_id", F.floor(F.col("event_time_ms") / bucket_ms).alias("bucket")))
    w = Window.partitionBy("item_id").orderBy("bucket").rangeBetween(-buckets, 0)
    return sums.select("item_id", "bucket", F.sum("views").over(w).alias("views"), F.sum("likes").over(w).alias("likes")).withColumn("ctr", ratio("likes", "views"))


def last_items(events: DataFrame, n: int = 8) -> DataFrame:
    """Each user's last ``n`` items by arrival, oldest first, repeats kept, with the time of the last event applied."""
    recent = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    kept = events.withColumn("r", F.row_number().over(recent)).filter(F.col("r") <= n)
    return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item_id"))), lambda x: x["item_id"].cast("string")), ",").alias("last_items"), F.max_by("event_time_ms", "event_id").alias("last_event_ms"))


def _each(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<long>")


def publications(events: DataFrame, intervals: list[int]) -> DataFrame:
    """``(interval_ms, publish_ms)``: the first event arms the clock; each later publication is at the first event whose time is an interval or more past the last one.

    The recurrence is sequential, so it runs over the distinct times only, in one pass per interval
    with a constant state; times come in order and as batches.
    """
    times = events.groupBy("event_time_ms").agg(F.lit(1).alias("one")).select("event_time_ms")
    plans = times.select("event_time_ms", F.explode(_each(intervals)).alias("interval_ms"))
    ordered = plans.repartition(len(intervals), "interval_ms").sortWithinPartitions("interval_ms", "event_time_ms")

    def run(batches):
        import pandas as pd

        key, last = None, None
        for b in batches:
            out = []
            for iv, t in zip(b["interval_ms"].tolist(), b["event_time_ms"].tolist(), strict=True):
                if iv != key:
                    key, last = iv, t
                elif t - last >= iv:
                    last = t
                    out.append((iv, t))
            yield pd.DataFrame(out, columns=["interval_ms", "publish_ms"])

    return ordered.mapInPandas(run, "interval_ms long, publish_ms long")


def skew(events: DataFrame, intervals: list[int]) -> DataFrame:
    """Per interval: what was published by the last publication against all events.

    ``published``, ``unpublished``, ``watermark_ms``, ``items_differ``, ``mean_abs_delta`` and ``max_abs_delta``
    of the items' rates; an item that was never published counts as 0.
    """
    last = publications(events, intervals).groupBy("interval_ms").agg(F.max("publish_ms").alias("until"), F.count("*").alias("publishes"))
    every = events.sparkSession.createDataFrame([(i,) for i in intervals], "interval_ms long")
    marks = every.join(last, "interval_ms", "left")
    online = events.join(F.broadcast(marks), F.col("event_time_ms") <= F.col("until"))
    on_items = online.groupBy("interval_ms", "item_id").agg(F.count("*").alias("v"), F.sum("type").alias("l"), F.max("event_time_ms").alias("seen"))
    offline = item_ctr(events).withColumn("interval_ms", F.explode(_each(intervals)))
    met = offline.join(on_items, ["interval_ms", "item_id"], "left").withColumn("delta", F.abs(F.col("ctr") - F.coalesce(F.try_divide(F.col("l"), F.col("v")), F.lit(0.0))))
    sums = met.groupBy("interval_ms").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("published"), (F.sum("views") - F.coalesce(F.sum("v"), F.lit(0))).alias("unpublished"), F.max("seen").alias("watermark_ms"), F.count_if(F.expr("v is null or v <> views or l <> likes")).alias("items_differ"), F.round(F.avg("delta"), 9).alias("mean_abs_delta"), F.round(F.max("delta"), 9).alias("max_abs_delta"))
    return sums.join(marks.select("interval_ms", F.coalesce("publishes", F.lit(0)).alias("publishes")), "interval_ms")
