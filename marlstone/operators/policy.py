"""Serving policy as tables: what is blocked, who is eligible, which list is given, and the records kept of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.evaluation import unseen
from marlstone.operators.tables import numbered

# fixed values: how long a request may be repeated, and what counts as shown
REQUEST_LIFE_MS = 86_400_000
VISIBLE_SHARE, VISIBLE_MS = 0.5, 800


def blocked(preferences: DataFrame, states: DataFrame) -> DataFrame:
    """``(user_id, item_id)``, once each: items with a preference of either sign, and those saved, watched or dismissed."""
    marked = states.filter("saved or watched or dismissed")
    return preferences.select("user_id", "item_id").unionByName(marked.select("user_id", "item_id")).distinct()


def eligible(candidates: DataFrame, trained: DataFrame, blocked: DataFrame, unavailable: DataFrame) -> DataFrame:
    """``candidates(user_id, item_id, ..)`` that the user neither trained on nor blocked, and that are not unavailable for all.

    Both user tables have the same key, so they meet the candidates in one exchange; a null id blocks nothing.
    """
    had = trained.select("user_id", "item_id").unionByName(blocked.select("user_id", "item_id"))
    return candidates.join(unavailable.select("item_id"), "item_id", "left_anti").join(had, ["user_id", "item_id"], "left_anti").select(*candidates.columns)


def first_of_each(rows: DataFrame, by: str, item: str, position: str) -> DataFrame:
    """Lists without repeats: of equal items of one list the first stays, in the order there was."""
    first = Window.partitionBy(by, item).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def available_ranking(popular: DataFrame, catalog: DataFrame) -> DataFrame:
    """``popular(item_id, pop)`` of the available items alone, numbered anew from 1."""
    left = popular.select("item_id", "pop").join(catalog.filter("available").select("item_id"), "item_id", "left_semi")
    return numbered(left.withColumnRenamed("pop", "_old"), "pop", "_old").select("item_id", "pop")


def select_items(asked: DataFrame, candidates: DataFrame, blocked: DataFrame, catalog: DataFrame, popular: DataFrame, k: int, policy: str, most: int = 512, depth: int = 512) -> DataFrame:
    """``(query_id, rank, item_id, source, candidate_source, degraded, exhausted)``: up to ``k`` items for each of ``asked(query_id, state)``.

    ``state`` is ``ready``, ``cold`` (no vector: popularity alone) or ``failed`` (retrieval broke: popularity, and degraded).  A ready
    query takes its eligible candidates in order of ``rank``, among the first ``most``; growing prefixes give the same list, as
    each is the beginning of the next.  What is short of ``k`` follows from ``popular(item_id, pop)``.  Items must be available in
    ``catalog(item_id, available)`` and not be blocked; a candidate that the catalog does not hold is an error, a popular one is left out
    (``not_shared`` finds these).  A query that gets nothing keeps one row with null item.
    """
    ready = asked.filter("state = 'ready'").select("query_id")
    mine = blocked.select("query_id", "item_id").distinct()
    known = candidates.filter(F.col("rank") <= most).select("query_id", "item_id", "rank").join(ready, "query_id", "left_semi").join(catalog.select("item_id", "available"), "item_id", "left")
    missing = F.raise_error(F.concat(F.lit("unknown item "), F.coalesce(F.col("item_id").cast("string"), F.lit("null")))).cast("boolean")
    taken = known.filter(F.coalesce("available", missing)).drop("available").join(mine, ["query_id", "item_id"], "left_anti")
    at = Window.partitionBy("query_id").orderBy("rank")
    taken = first_of_each(taken, "query_id", "item_id", "rank").withColumn("rank", F.row_number().over(at)).filter(F.col("rank") <= k)
    have = asked.select("query_id").join(taken.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").na.fill(0, ["have"])
    short = have.filter(F.col("have") < k)
    had = mine.unionByName(taken.select("query_id", "item_id")).distinct()
    fills = unseen(short.select("query_id"), had, available_ranking(popular, catalog), "query_id", "item_id", k, depth).join(short, "query_id")
    fills = fills.filter(F.col("rank") + F.col("have") <= k).select("query_id", "item_id", (F.col("rank") + F.col("have")).alias("rank"), F.lit("popularity").alias("source"))
    lists = taken.select("query_id", "item_id", "rank", F.lit(policy).alias("source")).unionByName(fills)
    n = F.count("item_id").over(Window.partitionBy("query_id"))
    found = asked.join(lists, "query_id", "left").withColumn("exhausted", n < k)
    return found.select("query_id", "rank", "item_id", "source", F.when(F.col("state") == "ready", policy).otherwise("popularity").alias("candidate_source"), (F.col("state") == "failed").alias("degraded"), "exhausted")


def issued_requests(requests: DataFrame) -> DataFrame:
    """``requests(seq, user_id, request_id, k, at_ms)`` with ``status`` against the user's first request under that id: computed, stored, or conflict (another k, or after a day)."""
    first = Window.partitionBy("user_id", "request_id").orderBy("seq")
    old_k, old_at = F.first("k").over(first), F.first("at_ms").over(first)
    same = old_k.eqNullSafe(F.col("k")) & (F.col("at_ms") - old_at < REQUEST_LIFE_MS)
    return requests.withColumn("status", F.when(F.row_number().over(first) == 1, "computed").when(F.coalesce(same, F.lit(False)), "stored").otherwise("conflict"))


def displayed(views: DataFrame) -> DataFrame:
    """``views(.., visible_share, visible_ms)`` that count as shown: half visible for 0.8 s."""
    return views.filter((F.col("visible_share") >= VISIBLE_SHARE) & (F.col("visible_ms") >= VISIBLE_MS))


def availability(toggles: DataFrame) -> DataFrame:
    """``(item_id, unavailable, changes)`` of ``toggles(seq, item_id, value)``: the last value; every toggle is a change of the generation, a repeated one too."""
    return toggles.groupBy("item_id").agg(F.max_by("value", "seq").alias("unavailable"), F.count("*").alias("changes"))


def registered(models: DataFrame) -> DataFrame:
    """Models by ``digest``: the first by ``seq`` stays, later ones under the same digest are ignored."""
    first = Window.partitionBy("digest").orderBy("seq")
    return models.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def delivered(outbox: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The ledger rows that pending deletions of ``outbox(id, kind, user_id, created_ms, delivered_ms)`` give, and the outbox with these delivered."""
    pending = (F.col("kind") == "delete") & F.col("delivered_ms").isNull()
    marked = outbox.withColumn("delivered_ms", F.when(pending, F.lit(now_ms).cast("long")).otherwise(F.col("delivered_ms")))
    return outbox.filter(pending).select("user_id", F.col("created_ms").alias("requested_ms")).distinct(), marked


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """``(keys, n)`` of keys that more than one row has; empty where they are unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def not_shared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, only_left, only_right)`` of what makes one side no permutation of the other, repeats included: rows over on either side."""
    sides = left.select(key, F.lit(1).alias("d")).unionByName(right.select(key, F.lit(-1).alias("d")))
    over = sides.groupBy(key).agg(F.sum("d").alias("d")).filter("d <> 0")
    return over.select(key, F.greatest(F.col("d"), F.lit(0)).alias("only_left"), F.greatest(-F.col("d"), F.lit(0)).alias("only_right"))


def bound(stores: DataFrame, model_digest: str) -> DataFrame:
    """Stores that were made for another model: any row is an error."""
    return stores.filter(~F.col("fingerprint").eqNullSafe(F.lit(model_digest)))
