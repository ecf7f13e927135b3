"""Operational analytics: percentiles, histograms, diagnosis, gates, capacity, alerts, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram limits: powers of two up to 131072.
LIMITS = [1 << i for i in range(18)]


def percentiles(samples: DataFrame, value: str, group: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles, mean, and coefficient of variation per group."""
    cv = F.when((F.count(value) < 2) | (F.avg(value) == 0), 0.0).otherwise(F.stddev_samp(value) / F.avg(value))
    return samples.groupBy(group).agg(
        F.count(value).alias("n"),
        *(F.round(F.percentile(value, q), 6).alias(f"p{n}") for q, n in ((0.5, "50"), (0.95, "95"), (0.99, "99"))),
        F.round(F.expr(f"percentile_disc(0.99) within group (order by {value})"), 6).alias("nearest99"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(cv, 6).alias("cv"),
    )


def duration_histogram(samples: DataFrame, value: str) -> DataFrame:
    """``(le, cumulative)`` rows of the fixed limits and of +Inf (null): one pass, one counter per limit."""
    one = samples.agg(*(F.count_if(F.col(value) <= x).alias(f"le_{x}") for x in LIMITS), F.count(value).alias("le_inf"))
    rows = F.array(*(F.struct(F.lit(x).cast("long").alias("le"), F.col(f"le_{x}").alias("cumulative")) for x in LIMITS), F.struct(F.lit(None).cast("long").alias("le"), F.col("le_inf").alias("cumulative")))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def bottleneck(shed: Column, late: Column, p99: Column, feature: Column, queue: Column, score: Column, ipc: Column | None = None, misses: Column | None = None) -> Column:
    """The first rule that holds names the bottleneck; without counters (``ipc`` null or 0) the cache rule does not hold."""
    ipc, misses = (F.lit(0.0) if c is None else c for c in (ipc, misses))
    return (
        F.when((shed > 0.05) | (late > 0.10), "overload")
        .when((feature > score) & (feature > 0.4 * p99), "feature_store_wait")
        .when((queue > score) & (queue > 0.4 * p99), "queueing")
        .when((ipc > 0) & (ipc < 0.8) & (misses > 20), "cache_miss_likely")
        .when(score > 0.5 * p99, "cpu_bound_scoring")
        .otherwise("unknown")
    )


def regression_verdict(base: DataFrame, candidate: DataFrame, most_ratio: float = 1.25, most_drop: float = 0.01) -> DataFrame:
    """One row from ``(p99, recall, qps)`` of both sides: medians of p99, mean recall, their change, and whether the candidate passes.

    A side without rows, or with any row that is null, not finite, not positive (p99, qps) or outside 0 to 1 (recall), fails.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = finite("p99") & finite("recall") & finite("qps") & (F.col("p99") > 0) & (F.col("qps") > 0) & F.col("recall").between(0, 1)
    sums = lambda d, n: d.agg(F.median("p99").alias(f"{n}_p99"), F.avg("recall").alias(f"{n}_recall"), F.bool_and(F.coalesce(sound, F.lit(False))).alias(f"{n}_sound"))
    both = sums(base, "base").withColumn("one", F.lit(1)).join(sums(candidate, "cand").withColumn("one", F.lit(1)), "one").drop("one")
    both = both.withColumn("ratio", F.try_divide("cand_p99", "base_p99")).withColumn("drop", F.col("base_recall") - F.col("cand_recall"))
    ok = F.col("base_sound") & F.col("cand_sound") & (F.col("ratio") <= most_ratio) & (F.col("drop") <= most_drop)
    return both.select(*(F.round(c, 6).alias(c) for c in ("base_p99", "cand_p99", "ratio", "drop")), F.coalesce(ok, F.lit(False)).alias("passed"))


def capacity(kernels: DataFrame, instances: DataFrame, qps: float, items: float, replicas: int, headroom: float, usable: float = 0.8) -> DataFrame:
    """Hosts and cost of every kernel on every instance type: both are short price lists.

    ``kernels(kernel, qps_per_core, bytes_per_item)``, ``instances(instance, vcpu, mem_gib, usd_per_hour)``.
    """
    k, i = kernels.withColumn("one", F.lit(1)), instances.withColumn("one", F.lit(1))
    met = k.join(i, "one").drop("one")
    compute = F.ceil(qps / (F.col("qps_per_core") * F.col("vcpu") * headroom))
    memory = F.ceil(items * F.col("bytes_per_item") * replicas / (F.col("mem_gib") * F.lit(2.0**30) * usable))
    met = met.withColumn("compute_hosts", compute.cast("long")).withColumn("memory_hosts", memory.cast("long"))
    met = met.withColumn("hosts", F.greatest("compute_hosts", "memory_hosts"))
    bound = F.when(F.col("memory_hosts") > F.col("compute_hosts"), "memory").otherwise("compute")
    hourly = F.col("hosts") * F.col("usd_per_hour")
    return met.select("kernel", "instance", "compute_hosts", "memory_hosts", "hosts", bound.alias("bound_by"), F.round(hourly, 6).alias("usd_per_hour"), F.round(hourly / (qps * 3600) * 1e6, 9).alias("usd_per_million"))


def held_alerts(series: DataFrame, threshold: float, least_volume: int, hold: int) -> DataFrame:
    """``(bucket, ratio, firing)`` of ``series(bucket, failures, total)``: fires once the ratio has been above the threshold with enough volume for ``hold`` buckets in a row.

    The series is one row per time bucket, after aggregation; a bucket without rows breaks the run.
    """
    bad = F.coalesce((F.try_divide("failures", "total") > threshold) & (F.col("total") >= least_volume), F.lit(False))
    last = Window.orderBy("bucket").rangeBetween(-(hold - 1), 0)
    marked = series.withColumn("bad", bad.cast("int"))
    return marked.select("bucket", F.round(F.coalesce(F.try_divide("failures", "total"), F.lit(0.0)), 6).alias("ratio"), (F.sum("bad").over(last) == hold).alias("firing"))


def episodes(calls: DataFrame) -> DataFrame:
    """``(thread, episode, begin, end, n_calls)``: from each opening call to the next closing call of the same thread.

    ``calls(thread, at, name)`` with names open, close and others: gaps and islands by running counts.
    """
    w = Window.partitionBy("thread").orderBy("at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = calls.withColumn("opened", F.sum(F.when(F.col("name") == "open", 1).otherwise(0)).over(w)).withColumn("closed", F.coalesce(F.sum(F.when(F.col("name") == "close", 1).otherwise(0)).over(before), F.lit(0)))
    inside = marked.filter("opened > 0").withColumn("since", F.max(F.when(F.col("name") == "open", F.col("closed"))).over(w))
    kept = inside.filter("closed = since")
    return kept.groupBy("thread", F.col("closed").alias("episode")).agg(F.min(F.when(F.col("name") == "open", F.col("at"))).alias("begin"), F.max(F.when(F.col("name") == "close", F.col("at"))).alias("end"), F.count("*").alias("n_calls")).filter("end is not null")
