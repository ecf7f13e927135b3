"""Request traces: names joined to calls, episodes from a first copy to a synchronisation, device work and host ranges inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def named(calls: DataFrame, names: DataFrame) -> DataFrame:
    """``calls`` with the text of their ``name_id`` as ``name``; a call whose own ``text`` is known keeps it, one without either goes."""
    met = calls.join(names.select(F.col("id").alias("name_id"), F.col("value").alias("known")), "name_id", "left")
    text = F.coalesce("text", "known") if "text" in calls.columns else F.col("known")
    return met.withColumn("name", text).drop("known", "name_id").filter("name is not null")


def episodes(calls: DataFrame, first: str, last: str) -> DataFrame:
    """``calls(thread, start, end, correlation, name)`` that belong to an episode, with ``episode``, its ``begin`` and ``until``.

    An episode of a thread goes from a call named ``first...`` to the end of the next one named ``last...``; inside it a further
    ``first`` opens nothing, and one that is never closed is none.  Threads are traced on their own.
    """
    w = Window.partitionBy("thread").orderBy("start", "correlation")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = F.col("name").startswith(first), F.col("name").startswith(last)
    marked = calls.withColumn("closed", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)))
    inside = marked.withColumn("open", F.max(opens.cast("int")).over(Window.partitionBy("thread", "closed").orderBy("start", "correlation"))).filter("open = 1")
    e = Window.partitionBy("thread", "closed")
    whole = inside.withColumn("begin", F.min("start").over(e)).withColumn("until", F.max(F.when(closes, F.col("end"))).over(e)).filter("until is not null")
    return whole.withColumnRenamed("closed", "episode").drop("open")


def device_work(inside: DataFrame, kernels: DataFrame) -> DataFrame:
    """``(thread, episode, kernels, busy, outside)``: the ``kernels(start, end, correlation)`` that an episode's calls started, and how many lie outside its interval."""
    ids = inside.select("thread", "episode", "begin", "until", "correlation").distinct()
    met = ids.join(kernels, "correlation")
    out = (F.col("start") < F.col("begin")) | (F.col("end") > F.col("until"))
    return met.groupBy("thread", "episode").agg(F.count("*").alias("kernels"), F.sum(F.col("end") - F.col("start")).alias("busy"), F.count_if(out).alias("outside"))


def contained(inside: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(thread, episode, name, offset, duration)``: the host ``ranges(thread, start, end, name)`` that lie wholly in an episode of their thread.

    Episodes of a thread do not overlap, so a range can lie only in the last one that begins at or before it: a
    running maximum over the union of both in order of time finds it, without a join on the interval.
    """
    ends = inside.groupBy("thread", "episode").agg(F.first("begin").alias("begin"), F.first("until").alias("until"))
    e = ends.select("thread", F.col("begin").alias("at"), F.lit(0).alias("k"), F.struct("begin", "until", "episode").alias("e"), F.lit(None).cast("struct<start:long,end:long,name:string>").alias("r"))
    r = ranges.select("thread", F.col("start").alias("at"), F.lit(1).alias("k"), F.lit(None).cast(e.schema["e"].dataType).alias("e"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name").alias("r"))
    w = Window.partitionBy("thread").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    met = e.unionByName(r).withColumn("e", F.last("e", ignorenulls=True).over(w)).filter("r is not null and e is not null and r.end <= e.until")
    return met.select("thread", "e.episode", "r.name", (F.col("r.start") - F.col("e.begin")).alias("offset"), (F.col("r.end") - F.col("r.start")).alias("duration"))
