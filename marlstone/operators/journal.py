"""Feedback journal: conflicts, attribution, projections, retention, limits, selection policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.evaluation import unseen
from marlstone.operators.tables import remove, written

DAY_MS = 86_400_000


def accepted(events: DataFrame, impressions: DataFrame | None = None, exposures: DataFrame | None = None) -> DataFrame:
    """``events`` in order of ``seq`` with ``status``: accepted, duplicate, conflict, unknown_kind, expired, not_issued, too_early or not_shown.

    ``events(seq, event_id, user_id, item_id, kind, event_time_ms[, request_id, received_ms])``; without request_id the user and item stand for
    the request.  An accepted row claims its event_id, and its request, item and kind; no other row claims anything.  Against what was
    accepted before it, a row is a duplicate (its event_id with the same payload) or a conflict (with another payload, or its request, item and
    kind under another event_id); an outcome needs an accepted ``shown`` of its request and item.  With ``impressions(request_id, user_id, created_ms)``
    and ``exposures(request_id, item_id)`` a row must reference an issued item of the same user, at most 30 s before its
    recommendation; with ``received_ms`` it must be at most 24 hours old and 30 s ahead.

    Where no row of a request and item shares its event_id with another, one pass decides: the first shown, then the first of each outcome after it.
    The rest goes in rounds: rows that only wait for undecided earlier ones are decided in the next one.
    Rounds go through written tables, and each works on keys, so nothing is collected.
    """
    request = F.col("request_id") if "request_id" in events.columns else F.struct("user_id", "item_id")
    payload = [c for c in events.columns if c not in ("seq", "received_ms")]
    rows = events.withColumn("_payload", F.struct(*payload)).withColumn("_key", F.struct(request.alias("r"), F.col("item_id").alias("i")))
    why = F.when(~F.coalesce(F.col("kind").isin("shown", "save", "dismiss", "watched"), F.lit(False)), "unknown_kind")
    late = F.lit(None).cast("string")
    if "received_ms" in events.columns:
        late = F.when(~F.col("event_time_ms").between(F.col("received_ms") - DAY_MS, F.col("received_ms") + 30_000), "expired")
    if impressions is not None:
        issued = exposures.select("request_id", "item_id").distinct().join(impressions.select("request_id", F.col("user_id").alias("_u"), F.col("created_ms").alias("_c")), "request_id")
        rows = rows.join(issued, ["request_id", "item_id"], "left")
        late = F.coalesce(late, F.when(~F.coalesce(F.col("_u") == F.col("user_id"), F.lit(False)), "not_issued").when(F.col("event_time_ms") < F.col("_c") - 30_000, "too_early"))
    rows = rows.withColumn("status", why).withColumn("_late", late).drop("_u", "_c")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spark = events.sparkSession
    by = Window.partitionBy
    rows = rows.withColumn("_n", F.count("*").over(by("event_id"))).withColumn("_single", F.max("_n").over(by("_key")) == 1)
    sound, shows = F.col("status").isNull() & F.col("_late").isNull(), F.col("kind") == "shown"
    rows = rows.withColumn("_from", F.min(F.when(sound & shows, F.col("seq"))).over(by("_key")))
    rows = rows.withColumn("_first", F.min(F.when(sound & (shows | (F.col("seq") > F.col("_from"))), F.col("seq"))).over(by("_key", "kind")))
    once = F.when(F.col("_late").isNotNull(), F.col("_late")).when(~shows & ~F.coalesce(F.col("seq") > F.col("_from"), F.lit(False)), "not_shown").when(F.col("seq") == F.col("_first"), "accepted").otherwise("conflict")
    rows = rows.withColumn("status", F.when(F.col("_single"), F.coalesce("status", once)).otherwise(F.col("status"))).drop("_n", "_from", "_first")
    rows, _ = written(rows, "journal")
    plain = rows.filter("_single").drop("_payload", "_key", "_late", "_single")
    rows = rows.filter("not _single").drop("_single")
    if rows.isEmpty():
        return plain
    paths = []
    while True:
        taken, open_ = F.col("status") == "accepted", F.col("status").isNull()
        some = lambda c, w: F.coalesce(F.max(c.cast("int")).over(w), F.lit(0)) == 1
        by_id, by_item, by_key = before("event_id"), before("_key"), before("_key", "kind")
        shown = F.col("kind") == "shown"
        seen = rows.select(
            "*",
            F.last(F.when(taken, F.col("_payload")), ignorenulls=True).over(by_id).alias("_old"),
            some(open_, by_id).alias("_id_waits"),
            some(taken & shown, by_item).alias("_shown"),
            some(open_ & shown, by_item).alias("_shown_waits"),
            some(taken, by_key).alias("_claimed"),
            some(open_, by_key).alias("_key_waits"),
        )
        found = (
            F.when(F.col("_old").isNotNull(), F.when(F.col("_old").eqNullSafe(F.col("_payload")), "duplicate").otherwise("conflict"))
            .when(F.col("_id_waits"), None)
            .when(F.col("_late").isNotNull(), F.col("_late"))
            .when(~shown & ~F.col("_shown") & F.col("_shown_waits"), None)
            .when(~shown & ~F.col("_shown"), "not_shown")
            .when(F.col("_claimed"), "conflict")
            .when(F.col("_key_waits"), None)
            .otherwise("accepted")
        )
        rows = seen.withColumn("status", F.coalesce("status", found)).drop("_old", "_id_waits", "_shown", "_shown_waits", "_claimed", "_key_waits")
        rows, path = written(rows, "journal")
        paths.append(path)
        if rows.filter("status is null").isEmpty():
            break
    for path in paths[:-1]:
        remove(spark, path)
    return plain.unionByName(rows.drop("_payload", "_key", "_late"))


def projection(journal: DataFrame) -> DataFrame:
    """``(item_id, shown, saved)`` of the accepted rows."""
    return journal.filter("status = 'accepted'").groupBy("item_id").agg(F.count_if(F.expr("kind = 'shown'")).alias("shown"), F.count_if(F.expr("kind = 'save'")).alias("saved"))


def generation(journal: DataFrame) -> DataFrame:
    """One row: how many changes were accepted, and the time of the last one."""
    return journal.filter("status = 'accepted'").agg(F.count("*").alias("generation"), F.max("event_time_ms").alias("last_event_ms"))


def exposures(responses: DataFrame) -> DataFrame:
    """``(request_id, item_id, position)`` of ``responses(request_id, items)``."""
    return responses.select("request_id", F.posexplode("items").alias("position", "item_id"))


def replayed(requests: DataFrame) -> DataFrame:
    """``requests(seq, request_id, user_id, k)`` with ``status``: the first of a request_id is computed, the same again is answered from store, another under that id is a conflict."""
    first = F.first(F.struct("user_id", "k")).over(Window.partitionBy("request_id").orderBy("seq"))
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
    return requests.withColumn("status", F.when(n == 1, "computed").when(first.eqNullSafe(F.struct("user_id", "k")), "stored").otherwise("conflict"))


def attributed(journal: DataFrame) -> DataFrame:
    """The journal with ``reject``: an outcome without an earlier ``shown`` of that user and item, or of an unknown kind; else null."""
    w = Window.partitionBy("user_id", "item_id")
    shown = F.min(F.when(F.col("kind") == "shown", F.col("seq"))).over(w)
    known = F.col("kind").isin("shown", "save", "dismiss", "watched")
    return journal.withColumn("reject", F.when(~known, "unknown_kind").when((F.col("kind") != "shown") & (shown.isNull() | (shown >= F.col("seq"))), "not_shown"))


def survivors(journal: DataFrame, now_ms: int, days: dict[str, int]) -> DataFrame:
    """Rows not older than their kind's days of retention; kinds without one stay."""
    limit = F.lit(None).cast("long")
    for kind, n in days.items():
        limit = F.when(F.col("kind") == kind, F.lit(int(now_ms - n * DAY_MS))).otherwise(limit)
    return journal.filter(limit.isNull() | (F.col("event_time_ms") >= limit))


def maintained(tables: dict[str, DataFrame], now_ms: int) -> dict[str, DataFrame]:
    """What periodic maintenance leaves of each table that is there.

    Sign-in flows live 10 minutes; sessions 7 days, and 1 day after they were last seen; events, requests and mutations 90 days; rate
    windows the current minute and two before it; delivered messages 8 days.
    """
    old = lambda c, ms: F.col(c) < now_ms - ms
    gone = {
        "oauth_flows": lambda: old("created_ms", 600_000),
        "sessions": lambda: old("created_ms", 7 * DAY_MS) | old("seen_ms", DAY_MS),
        "events": lambda: old("created_ms", 90 * DAY_MS),
        "requests": lambda: old("created_ms", 90 * DAY_MS),
        "mutations": lambda: old("created_ms", 90 * DAY_MS),
        "rate_limits": lambda: F.col("window") < now_ms // 60_000 - 2,
        "outbox": lambda: F.col("delivered_ms").isNotNull() & old("created_ms", 8 * DAY_MS),
    }
    return {k: t.filter(~gone[k]()) if k in gone else t for k, t in tables.items()}


def valid_sessions(sessions: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """Sessions of users that are there and not disabled, created in the last 7 days and seen in the last one."""
    alive = (F.col("created_ms") > now_ms - 7 * DAY_MS) & (F.col("seen_ms") > now_ms - DAY_MS)
    return sessions.filter(alive).join(users.filter(~F.col("disabled")).select("user_id"), "user_id", "left_semi")


def rate_limited(events: DataFrame, limit: int, width_ms: int) -> DataFrame:
    """``(user_id, bucket, requests, rejected)`` of fixed windows that hold more than ``limit``."""
    counts = events.groupBy("user_id", F.floor(F.col("event_time_ms") / width_ms).alias("bucket")).agg(F.count("*").alias("requests"))
    return counts.withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0))).filter("rejected > 0")


def item_states(journal: DataFrame) -> DataFrame:
    """Sticky flags per user and item."""
    return journal.groupBy("user_id", "item_id").agg(*(F.bool_or(F.col("kind") == k).alias(n) for k, n in (("save", "saved"), ("watched", "watched"), ("dismiss", "dismissed"))))


def selected(candidates: DataFrame, blocked: DataFrame, features: DataFrame, popular: DataFrame, k: int, n_items: int, tiers: tuple[int, ...] = (64, 128, 256, 512), depth: int = 512) -> DataFrame:
    """``(query_id, item_id, rank, score, candidate_source, tier)``: eligible candidates by pilot score, filled up by popularity.

    ``candidates(query_id, item_id, score, rank)`` are retrieved lists; the tier is the smallest prefix with ``k`` items that
    are not ``blocked(query_id, item_id)``, else the largest.  Where it has fewer than ``k``, items of ``popular(item_id, pop)``, the whole ranking from 1, join as
    candidates of score least - 1 - (pop - 1) / ``n_items``; least is that of all candidates of the tier, blocked or not.  All go by
    score + 0.05 * saved / (shown + 2), then id.

    A saved item may overtake unsaved ones before it by at most 0.05, so fills are taken as far down the ranking as that reaches: k, the blocked ones,
    and 0.05 * ``n_items`` places more.  The first ``depth`` places travel with the plan.
    """
    eligible = candidates.join(blocked, ["query_id", "item_id"], "left_anti")
    at = Window.partitionBy("query_id")
    tier = F.lit(tiers[-1])
    for t in reversed(tiers):
        tier = F.when(F.col(f"n{t}") >= k, t).otherwise(tier)
    sizes = eligible.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= t).alias(f"n{t}") for t in tiers))
    chosen = candidates.groupBy("query_id").agg(*(F.min(F.when(F.col("rank") <= t, F.col("score"))).alias(f"low{t}") for t in tiers)).join(sizes, "query_id", "left").na.fill(0, [f"n{t}" for t in tiers])
    chosen = chosen.withColumn("tier", tier)
    pick = lambda prefix: F.coalesce(*(F.when(F.col("tier") == t, F.col(f"{prefix}{t}")) for t in tiers))
    chosen = chosen.select("query_id", "tier", pick("low").alias("low"), pick("n").alias("have"))
    inside = eligible.join(chosen, "query_id").filter(F.col("rank") <= F.col("tier"))
    open_ = chosen.filter(F.col("have") < k)
    reach = k + int(0.05 * n_items) + 1
    had = blocked.select("query_id", "item_id").unionByName(inside.select("query_id", "item_id")).distinct()
    fills = unseen(open_.select("query_id"), had, popular, "query_id", "item_id", reach, depth).drop("rank")
    fills = fills.join(open_, "query_id").select("query_id", "item_id", (F.col("low") - 1 - (F.col("pop") - 1) / F.lit(float(max(n_items, 1)))).alias("score"), "tier", F.lit("popular").alias("candidate_source"))
    every = inside.select("query_id", "item_id", "score", "tier", F.lit("retrieval").alias("candidate_source")).unionByName(fills).join(features, "item_id", "left")
    scored = every.withColumn("score", F.round(F.col("score") + F.coalesce(0.05 * F.col("saved") / (F.col("shown") + 2), F.lit(0.0)), 6))
    best = at.orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "item_id", "rank", "score", "candidate_source", "tier")
