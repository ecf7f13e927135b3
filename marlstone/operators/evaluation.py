"""Offline evaluation: splits, baselines, ranking metrics, cohorts, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.tables import numbered


def split_per_user(inter: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """Each user's last max(floor(n * share), 1) interactions are test; users with fewer than ``least`` are left out."""
    u = Window.partitionBy("user")
    ranked = inter.withColumn("rank_in_user", F.row_number().over(u.orderBy("ts", "item")) - 1).withColumn("n", F.count("*").over(u))
    tail = F.greatest(F.floor(F.col("n") * share), F.lit(1))
    return ranked.filter(F.col("n") >= least).select("user", "item", "ts", "rank_in_user", (F.col("rank_in_user") >= F.col("n") - tail).alias("test"))


def time_boundaries(inter: DataFrame, shares: tuple[float, ...] = (0.8, 0.9)) -> list[int]:
    """The element at position floor(n * share) of all times in order: interactions are counted per time first,
    and per-time counts are summed in order by range partitions, so no task sorts all rows."""
    counts = inter.groupBy("ts").agg(F.count("*").alias("n"))
    days = counts.withColumn("day", F.floor(F.col("ts") / 86_400_000))
    per_day = days.groupBy("day").agg(F.sum("n").alias("n")).orderBy("day").collect()  # one row per calendar day
    total, found = sum(r.n for r in per_day), []
    for share in shares:
        at, before = int(total * share), 0
        for r in per_day:
            if before + r.n > at:
                inside = sorted((x.ts, x.n) for x in days.filter(F.col("day") == r.day).select("ts", "n").collect())
                for ts, n in inside:
                    if before + n > at:
                        found.append(ts)
                        break
                    before += n
                break
            before += r.n
    return found


def popularity(train: DataFrame) -> DataFrame:
    """``(item, n, rank)``: distinct users per item, most first, then id.  Counting shrinks rows to one per item before the ranking."""
    counts = train.select("user", "item").distinct().groupBy("item").agg(F.count("*").alias("n"))
    return numbered(counts, "rank", F.desc("n"), F.col("item"))


def popular_unseen(users: DataFrame, train: DataFrame, k: int, depth: int = 512) -> DataFrame:
    """``(user, item, rank)``: the first ``k`` popular items that the user has not had."""
    ranking, seen = popularity(train).select("item", F.col("rank").alias("pop")), train.select("user", "item").distinct()
    return unseen(users.select("user").distinct(), seen, ranking, "user", "item", k, depth).select("user", "item", "rank")


def unseen(asked: DataFrame, had: DataFrame, ranking: DataFrame, by: str, item: str, k: int, depth: int = 512) -> DataFrame:
    """``(by, item, pop, rank)``: for each ``by`` of ``asked`` the first ``k`` items of ``ranking(item, pop)`` that are not in ``had(by, item)``.

    ``asked`` and ``had`` hold different rows; ``pop`` runs from 1.  The ``depth`` first items are a constant of the plan, and what each ``by`` has had of
    them is one array, so a list is made within its row.  One who has had m items finds ``k`` others among the first k + m: where the
    list is short and that is past ``depth``, it goes on by a join, for these alone.
    """
    start = ranking.filter(F.col("pop") <= depth)
    kind = ranking.schema[item].dataType.simpleString()
    top = F.array(*(F.lit(r[0]) for r in start.orderBy("pop").select(item).collect())).cast(f"array<{kind}>")
    none = F.array().cast(f"array<{kind}>")
    seen = had.join(asked, by, "left_semi").join(F.broadcast(start.select(item, F.lit(True).alias("_top"))), item, "left")
    seen = seen.groupBy(by).agg(F.count("*").alias("_m"), F.collect_list(F.when(F.col("_top"), F.col(item))).alias("_had"))
    lists = asked.join(seen, by, "left").withColumn("_open", F.slice(F.array_except(top, F.coalesce("_had", none)), 1, k))
    first = lists.select(by, F.posexplode("_open").alias("_at", item))
    first = first.select(by, item, F.array_position(top, F.col(item)).cast("int").alias("pop"), (F.col("_at") + 1).alias("rank"))
    short = lists.filter((F.size("_open") < k) & (F.coalesce("_m", F.lit(0)) + k > depth)).select(by, "_m", F.size("_open").alias("_found"))
    more = short.select(by, "_found", F.explode(F.sequence(F.lit(depth + 1), (F.coalesce("_m", F.lit(0)) + k).cast("int"))).alias("pop"))
    more = more.join(ranking.filter(F.col("pop") > depth).withColumn("pop", F.col("pop").cast("int")), "pop").join(had, [by, item], "left_anti")
    more = more.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("pop")) + F.col("_found")).filter(F.col("rank") <= k)
    return first.unionByName(more.select(by, item, "pop", "rank"))


def ranking_metrics(lists: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``(user, n_gold, hits, recall, ndcg)`` for each user of ``gold(user, item)``; gains are binary."""
    g = gold.select("user", "item").distinct()
    sizes = g.groupBy("user").agg(F.count("*").alias("n_gold"))
    hits = lists.filter(F.col("rank") <= k).join(g, ["user", "item"]).groupBy("user").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold").cast("int"))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    met = sizes.join(hits, "user", "left").na.fill(0, ["hits"]).na.fill(0.0, ["dcg"])
    return met.select("user", "n_gold", "hits", (F.col("hits") / F.col("n_gold")).alias("recall"), (F.col("dcg") / ideal).alias("ndcg"))


def list_shares(lists: DataFrame, ranking: DataFrame) -> DataFrame:
    """``(user, head_share)``: the share of a user's list that is among the first tenth, one item at least, of ``ranking(item, rank)``.

    The flag is joined on the item; only the head of the ranking takes part.
    """
    most = F.greatest(F.lit(1), F.floor(ranking.agg(F.count("*")).scalar() / 10))
    head = ranking.filter(F.col("rank") <= most).select("item", F.lit(1).alias("head"))
    return lists.join(head, "item", "left").groupBy("user").agg(F.avg(F.coalesce("head", F.lit(0))).alias("head_share"))


def coverage(lists: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: different items in all lists, items of the catalog, and their ratio."""
    found = lists.agg(F.countDistinct("item").alias("recommended"))
    return found.withColumn("items", catalog.agg(F.count("*")).scalar()).withColumn("coverage", F.try_divide("recommended", "items"))


def recall_ceiling(gold: DataFrame, k: int) -> DataFrame:
    """One row: users, mean number of gold items, and the highest recall that lists of ``k`` can have: min(k / mean, 1)."""
    sizes = gold.select("user", "item").distinct().groupBy("user").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("users"), F.avg("n").alias("mean_gold"), F.least(F.lit(1.0), k / F.avg("n")).alias("ceiling"))


def lift(metrics: DataFrame, policy: str, baseline: str) -> DataFrame:
    """One row from ``metrics(policy, recall)``: the gain of ``policy`` over ``baseline``, absolute and relative."""
    of = lambda p: F.max(F.when(F.col("policy") == p, F.col("recall")))
    return metrics.agg((of(policy) - of(baseline)).alias("lift"), ((of(policy) - of(baseline)) / F.greatest(of(baseline), F.lit(1e-9))).alias("relative"))


def random_lists(users: DataFrame, items: DataFrame, k: int, seed: int = 17) -> DataFrame:
    """``(user, item, rank)``: ``k`` items per user by chance, alike in every run.  Items are numbered; a user draws numbers by hash until ``k`` differ."""
    places = numbered(items.select("item").distinct(), "at", "item").withColumn("at", F.col("at") - 1)
    n = places.count()
    draws = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4 * k + 16)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("user"), i), F.lit(max(n, 1)))))
    drawn = users.select("user").distinct().select("user", F.posexplode(F.slice(draws, 1, min(k, n))).alias("rank", "at"))
    return drawn.join(places, "at").select("user", "item", (F.col("rank") + 1).alias("rank"))


def promoted(validation: DataFrame, low: DataFrame, baseline: str) -> DataFrame:
    """One row: the policy of ``validation(policy, ndcg)`` with the best ndcg, and that which is served: it, if the interval's ``low(low)`` is above 0, else ``baseline``."""
    best = validation.agg(F.max_by("policy", F.struct("ndcg", F.col("policy") == baseline)).alias("candidate"))
    both = best.withColumn("low", low.select("low").scalar())
    return both.select("candidate", F.when((F.col("candidate") != baseline) & F.coalesce(F.col("low") > 0, F.lit(False)), F.col("candidate")).otherwise(baseline).alias("served"))


def paired(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """``(user, difference)`` of a metric of the same users under two policies."""
    return a.select("user", F.col(column).alias("x")).join(b.select("user", F.col(column).alias("y")), "user").select("user", (F.col("x") - F.col("y")).alias("difference"))


def bootstrap_interval(differences: DataFrame, column: str, samples: int = 1000, seed: int = 13, id_col: str = "user") -> DataFrame:
    """``(n, mean, low, high)``: the 95 % interval of the mean by Poisson resampling.

    A row's number of copies per resample comes from a generator seeded with its id, so the result does not depend on how rows
    are dealt over tasks; tasks sum them, so rows never meet in one place and
    what is merged is one pair of sums per resample.  A constant has low = high = mean; no rows give nulls.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        total, weight, n, plain = np.zeros(samples), np.zeros(samples), 0, 0.0
        for b in batches:
            for i, x in zip(b["id"].tolist(), b["x"].to_numpy(dtype=float), strict=True):
                w = np.random.default_rng([seed, i & 0xFFFFFFFF, i >> 32 & 0xFFFFFFFF]).poisson(1.0, samples)
                total += w * x
                weight += w
                n, plain = n + 1, plain + x
        yield pd.DataFrame({"r": np.arange(samples), "t": total, "w": weight, "n": n, "p": plain})

    rows = differences.select(F.col(column).cast("double").alias("x"), F.xxhash64(id_col).alias("id")).filter("x is not null")
    sums = rows.mapInPandas(run, "r int, t double, w double, n long, p double").groupBy("r").agg(*(F.sum(c).alias(c) for c in "twnp"))
    mean = F.try_divide("t", "w")
    return sums.agg(F.max("n").alias("n"), F.max(F.try_divide("p", "n")).alias("mean"), F.percentile(mean, 0.025).alias("low"), F.percentile(mean, 0.975).alias("high"))
