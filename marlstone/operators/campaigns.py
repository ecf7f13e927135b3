"""Measurement campaigns: spread, calibration, histograms, shard tails, sweeps, ranked diagnosis, gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: histogram limits in microseconds.
LIMITS = [1 << i for i in range(18)]


def calibration(runs: DataFrame, value: str, group: str) -> DataFrame:
    """Per group of runs: mean, spread, standard error, and the smallest relative change that two runs can tell: 2 * sqrt(2) * sd / mean."""
    sd, mean = F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.avg(value)
    part = lambda x: F.when(mean != 0, x / mean).otherwise(0.0)
    return runs.groupBy(group).agg(F.count(value).alias("runs"), mean.alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.greatest(F.count(value), F.lit(1)))).alias("sem"), part(sd).alias("cv"), part(2 * math.sqrt(2) * sd).alias("detect_floor"))


def bucket_bounds(samples: DataFrame, value: str, group: str, quantile: float = 0.99) -> DataFrame:
    """Per group: count, mean, the first limit that holds the ``quantile`` of all values (null if none does), and how many exceed the last limit."""
    n = F.count(value)
    at_most = [F.count_if(F.col(value) <= x) for x in LIMITS]
    bound = F.coalesce(*(F.when(c >= F.ceil(n * quantile), x) for c, x in zip(at_most, LIMITS, strict=True)))
    return samples.groupBy(group).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > 0, bound).alias("upper"), (n - at_most[-1]).alias("overflow"))


def summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of ``attempted`` and ``failed`` and the range of ``p99`` by ``keys``."""
    return runs.groupBy(*keys).agg(F.sum("attempted").alias("attempted"), F.sum("failed").alias("failed"), F.min("p99").alias("least_p99"), F.max("p99").alias("most_p99"), F.count("*").alias("runs"))


def medians(runs: DataFrame, keys: list[str], base: Column) -> DataFrame:
    """Median p99 and least recall of ``runs(*keys, p99, recall)`` by ``keys``, and the median over that of the rows for which ``base`` holds, by the first key."""
    found = runs.groupBy(*keys).agg(F.median("p99").alias("p99"), F.min("recall").alias("least_recall"))
    against = found.filter(base).select(keys[0], F.col("p99").alias("base_p99"))
    return found.join(against, keys[0], "left").withColumn("ratio", F.try_divide("p99", "base_p99"))


def scatter_gather(calls: DataFrame) -> DataFrame:
    """One row from ``calls(request, shard, us)``: tails of single shards, of the slowest and the fastest of each request, and their amplification.

    A request ends with its slowest shard.  Percentiles come from counts by value, so no group holds all samples.
    """
    per = calls.groupBy("request").agg(F.max("us").alias("slowest"), F.min("us").alias("fastest"))
    pooled = percentile_of(calls.select(F.lit(0).alias("g"), F.col("us").alias("v")), 0.99).select(F.col("p").alias("shard_p99"), "g")
    slow = percentile_of(per.select(F.lit(0).alias("g"), F.col("slowest").alias("v")), 0.99).select(F.col("p").alias("e2e_p99"), F.col("n").alias("requests"), "g")
    fast = percentile_of(per.select(F.lit(0).alias("g"), F.col("fastest").alias("v")), 0.5).select(F.col("p").alias("fastest_p50"), "g")
    met = slow.join(pooled, "g").join(fast, "g")  # three single rows
    return met.select("requests", "shard_p99", "e2e_p99", "fastest_p50", F.when(F.col("shard_p99") > 0, F.col("e2e_p99") / F.col("shard_p99")).otherwise(0.0).alias("tail_amplification"))


def percentile_of(values: DataFrame, q: float) -> DataFrame:
    """``(g, n, p)``: the interpolated ``q`` percentile of ``values(g, v)`` per group.

    Values are counted first, combined on the map side.  Running counts by range of values find the two ranks that matter:
    ranges are 64 per group between its least and largest value, so a task sees a part of a group only, and only the ranges that
    hold the ranks are sorted.
    """
    counts = values.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    ends = counts.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    dealt = counts.join(ends, "g").withColumn("r", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 63)).otherwise(0))
    sizes = dealt.groupBy("g", "r").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    ranks = F.array(F.floor((F.col("total") - 1) * q), F.ceil((F.col("total") - 1) * q))
    whole = sizes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("r", "m"))).alias("ranges"), F.first("total").alias("total"))
    # at most 64 ranges: the range of a rank, and what lies before it
    running = F.aggregate("ranges", F.struct(F.lit(0).cast("long").alias("before"), F.array().cast("array<struct<r:bigint,before:bigint,m:bigint>>").alias("all")), lambda a, x: F.struct((a["before"] + x["m"]).alias("before"), F.array_append(a["all"], F.struct(x["r"].cast("long").alias("r"), a["before"].alias("before"), x["m"].alias("m"))).alias("all")))["all"]
    asked = whole.select("g", "total", F.explode(ranks).alias("rank"), running.alias("all")).distinct()
    asked = asked.select("g", "total", "rank", F.filter("all", lambda x: (x["before"] <= F.col("rank")) & (F.col("rank") < x["before"] + x["m"]))[0].alias("at")).select("g", "total", "rank", "at.r", "at.before")
    inside = dealt.select("g", "r", "v", "n").join(asked.select("g", "r").distinct(), ["g", "r"], "left_semi").groupBy("g", "r").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs"))
    found = asked.join(inside, ["g", "r"]).select("g", "total", "rank", F.aggregate("vs", F.struct(F.col("before").alias("seen"), F.lit(None).cast("double").alias("v")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["n"] > F.col("rank")), x["v"].cast("double")).otherwise(a["v"]).alias("v")))["v"].alias("v"))
    ends_ = found.groupBy("g").agg(F.first("total").alias("n"), F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    part = (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return ends_.select("g", "n", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("p"))


def first_reaching(sweep: DataFrame, key: str, setting: str, recall: str, goal: float = 0.99) -> DataFrame:
    """The smallest setting per key with the recall asked for; null where none has it."""
    return sweep.groupBy(key).agg(F.min(F.when(F.col(recall) >= goal, F.col(setting))).alias("first"), F.max(recall).alias("best"))


def hypotheses(snapshots: DataFrame, floor: float) -> DataFrame:
    """``(cell, rank, hypothesis, confidence, action)``: all explanations that the figures of ``snapshots`` allow, the likeliest first.

    ``snapshots(cell, p99, retrieve, score, feature, cv, recall)``.  Ties keep the order of the rules.
    """
    p99, room = F.greatest("p99", F.lit(1e-9)), F.col("recall") - floor
    share = lambda c: F.least(F.lit(1.0), F.col(c) / p99)
    rules = [
        ("retrieve_dominates", F.col("retrieve") > 0.5 * p99, share("retrieve"), F.when(room > 0.01, "ef").otherwise("kernel")),
        ("scoring_dominates", F.col("score") > 0.35 * p99, share("score"), F.lit("retrieve_k")),
        ("feature_store_wait", F.col("feature") > 0.25 * p99, share("feature"), F.lit("kernel")),
        ("measurement_unstable", F.col("cv") > 0.20, F.least(F.lit(1.0), F.col("cv")), F.lit("pin")),
        ("recall_headroom", room > 0.05, F.least(F.lit(1.0), room * 4), F.lit("ef")),
        ("recall_violation", room < 0.0, F.lit(1.0), F.lit("ef")),
    ]
    each = F.array(*(F.when(holds, F.struct((-sure).alias("down"), F.lit(i).alias("i"), F.lit(name).alias("hypothesis"), sure.alias("confidence"), action.alias("action"))) for i, (name, holds, sure, action) in enumerate(rules)))
    ranked = F.array_sort(F.filter(each, lambda x: x.isNotNull()))
    return snapshots.select("cell", F.posexplode(ranked).alias("rank", "h")).select("cell", (F.col("rank") + 1).alias("rank"), "h.hypothesis", "h.confidence", "h.action")


def accepted(pairs: DataFrame, recall_floor: float, rss_budget: float, multiple: float = 2.0) -> DataFrame:
    """``pairs(cell, best_p99, p99, sigma, recall, rss)`` with ``verdict``: the first gate that a candidate fails, else accepted."""
    noise = multiple * math.sqrt(2) * F.col("sigma")
    why = F.when(F.col("recall") < recall_floor, "recall").when(F.col("rss") > rss_budget, "memory").when(F.col("best_p99") - F.col("p99") <= noise, "noise").otherwise("accepted")
    return pairs.select("cell", why.alias("verdict"))


def slo(runs: DataFrame, most_failures: float = 0.001, most_p99: float = 5000.0) -> DataFrame:
    """``runs(cell, failure_rate, p99)`` with ``passed``."""
    return runs.withColumn("passed", F.coalesce((F.col("failure_rate") <= most_failures) & (F.col("p99") <= most_p99), F.lit(False)))


def retried(deliveries: DataFrame) -> DataFrame:
    """Fingerprints of ``deliveries(fingerprint, accepted)`` that were refused at least once and accepted at least once."""
    return deliveries.groupBy("fingerprint").agg(F.bool_or(~F.col("accepted")).alias("f"), F.bool_or("accepted").alias("s")).filter("f and s").select("fingerprint")


def recovered(alerts: DataFrame) -> DataFrame:
    """``(fingerprint, starts_at)`` of ``alerts(fingerprint, starts_at, status)`` that were both firing and resolved."""
    state = lambda s: F.bool_or(F.col("status") == s)
    return alerts.groupBy("fingerprint", "starts_at").agg(state("firing").alias("f"), state("resolved").alias("r")).filter("f and r").select("fingerprint", "starts_at")


def savings(costs: DataFrame, baseline: str) -> DataFrame:
    """``costs(kernel, instance, usd_per_hour)`` of every other kernel against ``baseline`` on the same instance: the share that is saved."""
    base = costs.filter(F.col("kernel") == baseline).select("instance", F.col("usd_per_hour").alias("base_usd"))
    return costs.filter(F.col("kernel") != baseline).join(base, "instance").select("kernel", "instance", "base_usd", "usd_per_hour", F.when(F.col("base_usd") > 0, 1 - F.col("usd_per_hour") / F.col("base_usd")).otherwise(0.0).alias("saved"))


def increases(samples: DataFrame, width_ms: int) -> DataFrame:
    """``(series, bucket, increase)`` of a counter ``samples(series, at, value)`` per window: the sum of its steps up; after a reset the counter starts from 0."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("series").orderBy("at"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return samples.withColumn("step", step).groupBy("series", F.floor(F.col("at") / width_ms).alias("bucket")).agg(F.sum("step").alias("increase"))
