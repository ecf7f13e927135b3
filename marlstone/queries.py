"""All queries of the engine by name, each over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import campaigns, ctr, evaluation, journal, operations, traces, vectors
from marlstone.operators.tables import numbered, written
from marlstone.plans import views
from marlstone.plans.views import EVT, INTER, JOURNAL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
HOUR = 3_600_000


def query(sql: str | None = None):
    """Register the function under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- features -------------------------------------------------------------------------------


@query(f"WITH {EVT} SELECT item_id, count(*) AS views, CAST(sum(type) AS BIGINT) AS likes, sum(type) / count(*) AS ctr FROM evt GROUP BY item_id")
def ctr_item(spark, sf_dir):
    return ctr.item_ctr(views.events(spark, sf_dir))


@query(f"WITH {EVT} SELECT item_id, event_time_ms - event_time_ms % {HOUR} AS window_start_ms, count(*) AS views, CAST(sum(type) AS BIGINT) AS likes, sum(type) / count(*) AS ctr FROM evt GROUP BY 1, 2")
def ctr_tumbling_1h(spark, sf_dir):
    return ctr.tumbling_ctr(views.events(spark, sf_dir), HOUR)


@query(f"WITH {EVT} SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, CAST(0 AS BIGINT) AS mismatched, count(DISTINCT item_id) AS total FROM evt")
def ctr_rollup_audit(spark, sf_dir):
    e = views.events(spark, sf_dir)
    return ctr.audit(ctr.rolled_up(ctr.tumbling_ctr(e, HOUR)), ctr.item_ctr(e), "item_id", ["views", "likes"])


@query(f"""WITH {EVT}, b AS (SELECT item_id, event_time_ms // 60000 AS bucket, count(*) AS v, sum(type) AS l FROM evt GROUP BY 1, 2)
SELECT item_id, bucket, CAST(sum(v) OVER w AS BIGINT) AS views, CAST(sum(l) OVER w AS BIGINT) AS likes, (sum(l) OVER w) / (sum(v) OVER w) AS ctr FROM b WINDOW w AS (PARTITION BY item_id ORDER BY bucket RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)""")
def ctr_sliding_60m(spark, sf_dir):
    return ctr.sliding_ctr(views.events(spark, sf_dir), 60_000, 60)


@query(f"""WITH {EVT}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM evt)
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY event_id) AS last_items, arg_max(event_time_ms, event_id) AS last_event_ms FROM r WHERE n <= 8 GROUP BY user_id""")
def user_last8(spark, sf_dir):
    return ctr.last_items(views.events(spark, sf_dir), 8)


@query(f"""WITH RECURSIVE {EVT}, iv(i) AS (VALUES (3600000), (86400000)),
c(i, t, k) AS (SELECT i, (SELECT min(event_time_ms) FROM evt), 0 FROM iv UNION ALL SELECT i, (SELECT min(event_time_ms) FROM evt WHERE event_time_ms >= c.t + c.i), k + 1 FROM c WHERE t IS NOT NULL),
marks AS (SELECT i, max(t) AS until, count(*) AS publishes FROM c WHERE k > 0 AND t IS NOT NULL GROUP BY i),
off AS (SELECT item_id, count(*) AS views, sum(type) AS likes FROM evt GROUP BY 1),
onl AS (SELECT i, item_id, count(*) AS v, sum(type) AS l, max(event_time_ms) AS seen FROM evt JOIN marks ON event_time_ms <= until GROUP BY 1, 2),
met AS (SELECT iv.i, off.*, v, l, seen, abs(likes / views - coalesce(l / v, 0)) AS delta FROM iv CROSS JOIN off LEFT JOIN onl ON onl.i = iv.i AND onl.item_id = off.item_id)
SELECT CAST(met.i AS BIGINT) AS interval_ms, CAST(coalesce(sum(v), 0) AS BIGINT) AS published, CAST(sum(views) - coalesce(sum(v), 0) AS BIGINT) AS unpublished, max(seen) AS watermark_ms, count(*) FILTER (WHERE v IS NULL OR v <> views OR l <> likes) AS items_differ, round(avg(delta), 9) AS mean_abs_delta, round(max(delta), 9) AS max_abs_delta, coalesce(max(publishes), 0) AS publishes
FROM met LEFT JOIN marks ON marks.i = met.i GROUP BY met.i""")
def skew_by_interval(spark, sf_dir):
    return ctr.skew(views.events(spark, sf_dir), [HOUR, 24 * HOUR])


@query(f"""WITH {EVT}, f AS (SELECT item_id, (SELECT max(event_time_ms) FROM evt) - event_time_ms AS age FROM evt)
SELECT count(*) AS n, round(quantile_cont(age, 0.5), 6) AS p50, round(quantile_cont(age, 0.99), 6) AS p99, CAST(max(age) AS BIGINT) AS oldest FROM f""")
def freshness_pctl(spark, sf_dir):
    e = views.events(spark, sf_dir)
    clock = e.agg(F.max("event_time_ms").alias("now")).withColumn("one", F.lit(1))
    aged = e.withColumn("one", F.lit(1)).join(F.broadcast(clock), "one").withColumn("age", F.col("now") - F.col("event_time_ms"))  # one row is broadcast
    return aged.agg(F.count("*").alias("n"), F.round(F.percentile("age", 0.5), 6).alias("p50"), F.round(F.percentile("age", 0.99), 6).alias("p99"), F.max("age").alias("oldest"))


@query(f"WITH {EVT} SELECT event_id, event_time_ms, user_id, item_id, type, false AS bad FROM evt")
def event17_roundtrip(spark, sf_dir):
    from marlstone.sources import event17

    packed = event17.encode(views.events(spark, sf_dir)).select("event_id", "payload")
    return event17.decode(packed).drop("payload")


# --- vectors --------------------------------------------------------------------------------

_CAT = "cat AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qry AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0)"
_SCORED = "s AS (SELECT query_id, item_id, round(list_inner_product(q, e), 6) + 0.0 AS score FROM qry CROSS JOIN cat), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def _query_set(spark, sf_dir):
    """The stated queries: every id divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_CAT}, {_SCORED} SELECT query_id, item_id, score, rank FROM t WHERE rank <= 10")
def topk_exact(spark, sf_dir):
    return vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 10)


@query(f"WITH {_CAT}, {_SCORED} SELECT query_id, item_id, score, rank FROM t WHERE rank <= 10")
def topk_sharded(spark, sf_dir):
    return vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 10, shards=8)


_QUANT = """z AS (SELECT id, v, CASE WHEN m > 0 THEN m / 127 ELSE 1.0 END AS sc FROM (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS m FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))),
c AS (SELECT id, sc, list_transform(v, lambda x: greatest(-127.0, least(127.0, sign(x / sc) * floor(abs(x / sc) + 0.5)))) AS c FROM z),
s AS (SELECT a.id AS query_id, b.id AS item_id, round(list_inner_product(a.c, b.c) * a.sc * b.sc, 6) + 0.0 AS score FROM c a CROSS JOIN c b WHERE a.id % 100 = 0)"""


@query(f"WITH {_QUANT}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT * FROM t WHERE rank <= 10")
def topk_int8(spark, sf_dir):
    return vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 10, int8=True)


def _profile_members(spark, sf_dir):
    """Liked items of all users, as catalog rows."""
    n = _catalog(spark, sf_dir).count()
    return views.interactions(spark, sf_dir).filter("rating >= 4").select(F.col("user").alias("query_id"), F.pmod("item", F.lit(n)).alias("item_id")).distinct()


@query(f"""WITH {INTER}, n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT DISTINCT "user" AS query_id, item % n AS item_id FROM inter, n WHERE rating >= 4),
d AS (SELECT query_id, d, sum(CAST(embedding[d] AS DOUBLE)) AS x FROM (SELECT query_id, embedding, unnest(range(1, 65)) AS d FROM m JOIN embeddings ON vec_id = item_id) GROUP BY 1, 2),
l AS (SELECT query_id, sqrt(sum(x * x)) AS norm FROM d GROUP BY 1)
SELECT query_id, CAST(d - 1 AS INTEGER) AS d, round(x / norm, 6) + 0.0 AS x FROM d JOIN l USING (query_id)""")
def centroid_foldin(spark, sf_dir):
    found = vectors.centroid(_profile_members(spark, sf_dir), _catalog(spark, sf_dir))
    return found.select("query_id", F.posexplode("embedding").alias("d", "x")).select("query_id", "d", (F.round("x", 6) + 0.0).alias("x"))


@query()
def als_foldin(spark, sf_dir):
    n = _catalog(spark, sf_dir).count()
    prefs = views.interactions(spark, sf_dir).filter("rating >= 4 or rating <= 2").select(F.col("user").alias("query_id"), F.pmod("item", F.lit(n)).alias("item_id"), F.when(F.col("rating") >= 4, 1).otherwise(-1).alias("value"))
    return vectors.als_fold_in(prefs.groupBy("query_id", "item_id").agg(F.max("value").alias("value")), _catalog(spark, sf_dir))


@query()
def als_train(spark, sf_dir):
    from pyspark.ml.recommendation import ALS

    liked = views.interactions(spark, sf_dir).filter("rating >= 4").select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.lit(1.0).alias("w"))
    model = ALS(rank=16, maxIter=5, regParam=0.05, implicitPrefs=True, alpha=40.0, userCol="user", itemCol="item", ratingCol="w", seed=7).fit(liked)
    return model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").alias("embedding"))


@query("SELECT count(*) * 10 AS n, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, sf_dir):
    """Approximate against exact lists of all stated queries: is the recall that was asked for, 0.9, reached?"""
    q, c = _query_set(spark, sf_dir), _catalog(spark, sf_dir)
    exact, _ = written(vectors.top_k(q, c, 10), "exact")
    near = vectors.ivf_top_k(q, c, 10, recall=0.95)
    met = exact.select("query_id", "item_id").join(near.select("query_id", "item_id", F.lit(1).alias("found")), ["query_id", "item_id"], "left")
    return met.agg(F.count("*").alias("n"), (F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("reached"))


@query(f"""WITH {EVT}, {_CAT}, {_SCORED}, r AS (SELECT query_id, item_id, score FROM t WHERE rank <= 100),
f AS (SELECT item_id, sum(type) / count(*) AS ctr FROM evt GROUP BY 1),
h AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM evt) WHERE n <= 8 GROUP BY 1, 2),
u AS (SELECT user_id AS query_id, sum(type) / count(*) AS uctr FROM evt GROUP BY 1),
x AS (SELECT query_id, r.item_id, round(score + 0.15 * coalesce(uctr, 0) + 0.1 * coalesce(ctr, 0) + 0.05 * (h.item_id IS NOT NULL)::INT, 6) AS final_score FROM r LEFT JOIN f USING (item_id) LEFT JOIN u USING (query_id) LEFT JOIN h ON h.user_id = query_id AND h.item_id = r.item_id),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, item_id) AS rank FROM x) SELECT query_id, item_id, final_score, rank FROM y WHERE rank <= 10""")
def recommend_flagship(spark, sf_dir):
    """Retrieve 100, join user and item rates and the user's last 8 items, rank linearly (1, 0.15, 0.10, 0.05), keep 10."""
    e = views.events(spark, sf_dir)
    retrieved = vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 100).select("query_id", "item_id", "score")
    recent = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    last = e.withColumn("n", F.row_number().over(recent)).filter("n <= 8").select(F.col("user_id").alias("query_id"), "item_id").distinct().withColumn("recent", F.lit(1))
    met = retrieved.join(ctr.item_ctr(e).select("item_id", "ctr"), "item_id", "left").join(last, ["query_id", "item_id"], "left")
    users = e.groupBy(F.col("user_id").alias("query_id")).agg((F.sum("type") / F.count("*")).alias("user_ctr"))
    met = met.join(users, "query_id", "left")
    final = F.round(F.col("score") + 0.15 * F.coalesce("user_ctr", F.lit(0.0)) + 0.1 * F.coalesce("ctr", F.lit(0.0)) + 0.05 * F.coalesce("recent", F.lit(0)), 6)
    best = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "item_id")
    return met.withColumn("final_score", final).withColumn("rank", F.row_number().over(best)).filter("rank <= 10").select("query_id", "item_id", "final_score", "rank")


# --- evaluation -----------------------------------------------------------------------------

_SPLIT = f"""{INTER}, sp AS (SELECT *, n - greatest(floor(n * 0.2), 1) AS cut FROM (SELECT "user", item, ts, rating, row_number() OVER (PARTITION BY "user" ORDER BY ts, item) - 1 AS rank_in_user, count(*) OVER (PARTITION BY "user") AS n FROM inter) WHERE n >= 5)"""
_POP = f"""{_SPLIT}, train AS (SELECT * FROM sp WHERE rank_in_user < cut), gold AS (SELECT * FROM sp WHERE rank_in_user >= cut),
pop AS (SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS rank FROM (SELECT item, count(DISTINCT "user") AS n FROM train GROUP BY item)),
lists AS (SELECT "user", item, rank FROM (SELECT u."user", p.item, row_number() OVER (PARTITION BY u."user" ORDER BY p.rank) AS rank FROM (SELECT DISTINCT "user" FROM gold) u CROSS JOIN pop p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = u."user" AND t.item = p.item)) WHERE rank <= 10),
mt AS (SELECT g."user", count(*) AS n_gold, count(l.rank) AS hits, coalesce(sum(1 / log2(l.rank + 1)), 0) AS dcg FROM gold g LEFT JOIN lists l ON l."user" = g."user" AND l.item = g.item GROUP BY 1),
met AS (SELECT *, list_sum(list_transform(range(1, least(10, n_gold) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM mt)"""


def _split(spark, sf_dir):
    from marlstone.operators.evaluation import split_per_user

    s, _ = written(split_per_user(views.interactions(spark, sf_dir)), "split")
    return s.filter("not test"), s.filter("test")


@query(f'WITH {_SPLIT} SELECT "user", item, ts, rank_in_user, rank_in_user >= cut AS test FROM sp')
def split_per_user(spark, sf_dir):
    return evaluation.split_per_user(views.interactions(spark, sf_dir))


@query(f"WITH {INTER}, o AS (SELECT list(ts ORDER BY ts) AS l FROM inter) SELECT l[CAST(floor(len(l) * 0.8) AS BIGINT) + 1] AS validation_from, l[CAST(floor(len(l) * 0.9) AS BIGINT) + 1] AS test_from FROM o")
def split_global_time(spark, sf_dir):
    return spark.createDataFrame([tuple(evaluation.time_boundaries(views.interactions(spark, sf_dir)))], "validation_from long, test_from long")


@query(f"WITH {_POP} SELECT item, n, rank FROM pop")
def popularity_distinct(spark, sf_dir):
    return evaluation.popularity(_split(spark, sf_dir)[0])


@query(f'WITH {_POP} SELECT "user", item, rank FROM lists')
def baseline_popular(spark, sf_dir):
    train, gold = _split(spark, sf_dir)
    return evaluation.popular_unseen(gold, train, 10)


@query(f'WITH {_POP} SELECT "user", n_gold, hits, round(hits / n_gold, 9) AS recall, round(dcg / ideal, 9) AS ndcg FROM met')
def recall_ndcg_users(spark, sf_dir):
    train, gold = _split(spark, sf_dir)
    m = evaluation.ranking_metrics(evaluation.popular_unseen(gold, train, 10), gold, 10)
    return m.select("user", "n_gold", "hits", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


@query(f"""WITH {_POP} SELECT CASE WHEN "user" % 2 = 0 THEN 'even' ELSE 'odd' END AS cohort, count(*) AS users, round(avg(hits / n_gold), 9) AS recall, round(avg(dcg / ideal), 9) AS ndcg FROM met GROUP BY 1""")
def cohort_metrics(spark, sf_dir):
    train, gold = _split(spark, sf_dir)
    m = evaluation.ranking_metrics(evaluation.popular_unseen(gold, train, 10), gold, 10)
    return m.groupBy(F.when(F.col("user") % 2 == 0, "even").otherwise("odd").alias("cohort")).agg(F.count("*").alias("users"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("ndcg"), 9).alias("ndcg"))


@query(f'WITH {_POP} SELECT count(*) AS overlaps, count(DISTINCT g."user") AS users FROM gold g JOIN lists l ON l."user" = g."user" AND l.item = g.item')
def gold_overlap(spark, sf_dir):
    train, gold = _split(spark, sf_dir)
    lists = evaluation.popular_unseen(gold, train, 10)
    return lists.join(gold.select("user", "item"), ["user", "item"]).agg(F.count("*").alias("overlaps"), F.countDistinct("user").alias("users"))


@query(f"""WITH {INTER}, p AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, item) AS n, count(*) OVER (PARTITION BY "user") AS total FROM inter WHERE rating >= 4)
SELECT "user", string_agg(CAST(item AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 5) AS seeds, count(*) FILTER (WHERE n > 5) AS n_gold, CASE WHEN max(total) < 5 THEN 'insufficient_onboarding' WHEN max(total) = 5 THEN 'no_targets' ELSE 'ok' END AS status FROM p GROUP BY 1""")
def onboarding_examples(spark, sf_dir):
    w = Window.partitionBy("user")
    p = views.interactions(spark, sf_dir).filter("rating >= 4").withColumn("n", F.row_number().over(w.orderBy("ts", "item")))
    seeds = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "item")))), lambda x: x["item"].cast("string")), ",")
    status = F.when(F.count("*") < 5, "insufficient_onboarding").when(F.count("*") == 5, "no_targets").otherwise("ok")
    return p.groupBy("user").agg(seeds.alias("seeds"), F.count_if(F.expr("n > 5")).alias("n_gold"), status.alias("status"))


def _metrics(spark, sf_dir):
    """Per-user metrics of the popular and the random lists, the lists, and the ranking; the split is written once."""
    split, _ = written(evaluation.split_per_user(views.interactions(spark, sf_dir)), "split")
    train, gold = split.filter("not test"), split.filter("test")
    popular = evaluation.popular_unseen(gold, train, 10)
    chance = evaluation.random_lists(gold, train, 10)
    return train, gold, popular, evaluation.ranking_metrics(popular, gold, 10), evaluation.ranking_metrics(chance, gold, 10)


@query()
def bootstrap_ci(spark, sf_dir):
    """The interval of the paired difference of popular and random lists."""
    _, _, _, popular, chance = _metrics(spark, sf_dir)
    return evaluation.bootstrap_interval(evaluation.paired(popular, chance, "ndcg"), "difference")


@query()
def policy_promotion(spark, sf_dir):
    _, _, _, popular, chance = _metrics(spark, sf_dir)
    low = evaluation.bootstrap_interval(evaluation.paired(popular, chance, "ndcg"), "difference")
    scores = popular.agg(F.lit("popularity").alias("policy"), F.avg("ndcg").alias("ndcg")).unionByName(chance.agg(F.lit("random").alias("policy"), F.avg("ndcg").alias("ndcg")))
    return evaluation.promoted(scores, low, "random")


@query(f"""WITH {_POP} SELECT count(DISTINCT l.item) AS recommended, (SELECT count(*) FROM pop) AS items, round(count(DISTINCT l.item) / (SELECT count(*) FROM pop), 9) AS coverage FROM lists l""")
def catalog_coverage(spark, sf_dir):
    train, gold = _split(spark, sf_dir)
    found = evaluation.coverage(evaluation.popular_unseen(gold, train, 10), train.select("item").distinct())
    return found.withColumn("coverage", F.round("coverage", 9))


@query(f"""WITH {_POP}, hd AS (SELECT item FROM pop WHERE rank <= greatest(1, (SELECT count(*) FROM pop) // 10)) SELECT "user", round(avg((hd.item IS NOT NULL)::INT), 9) AS head_share FROM lists LEFT JOIN hd ON hd.item = lists.item GROUP BY 1""")
def popular_decile_share(spark, sf_dir):
    train, gold = _split(spark, sf_dir)
    ranking, _ = written(evaluation.popularity(train), "popularity")
    return evaluation.list_shares(evaluation.popular_unseen(gold, train, 10), ranking).withColumn("head_share", F.round("head_share", 9))


@query(f"""WITH {_POP}, g AS (SELECT "user", count(*) AS n FROM gold GROUP BY 1) SELECT count(*) AS users, round(avg(n), 9) AS mean_gold, round(least(1.0, 10 / avg(n)), 9) AS ceiling FROM g""")
def recall_ceiling(spark, sf_dir):
    found = evaluation.recall_ceiling(_split(spark, sf_dir)[1], 10)
    return found.select("users", F.round("mean_gold", 9).alias("mean_gold"), F.round("ceiling", 9).alias("ceiling"))


@query(f"""WITH {_POP}, flat AS (SELECT avg(coalesce(h, 0) / n_gold) AS r FROM met LEFT JOIN (SELECT g."user", count(*) AS h FROM gold g JOIN pop p ON p.item = g.item AND p.rank <= 10 GROUP BY 1) USING ("user")), best AS (SELECT avg(hits / n_gold) AS r FROM met)
SELECT round(best.r - flat.r, 9) AS lift, round((best.r - flat.r) / greatest(flat.r, 1e-9), 9) AS relative FROM best, flat""")
def lift_over_flat_list(spark, sf_dir):
    """Recall of popular items a user has not had, against one list of popular items for all."""
    split, _ = written(evaluation.split_per_user(views.interactions(spark, sf_dir)), "split")
    train, gold = split.filter("not test"), split.filter("test")
    ranking, _ = written(evaluation.popularity(train), "popularity")
    top = ranking.filter("rank <= 10").select("item", "rank")
    flat = gold.select("user", "item").join(F.broadcast(top), "item")  # ten rows
    own = evaluation.ranking_metrics(evaluation.popular_unseen(gold, train, 10), gold, 10).agg(F.lit("unseen").alias("policy"), F.avg("recall").alias("recall"))
    same = evaluation.ranking_metrics(flat, gold, 10).agg(F.lit("flat").alias("policy"), F.avg("recall").alias("recall"))
    return evaluation.lift(own.unionByName(same), "unseen", "flat").select(F.round("lift", 9).alias("lift"), F.round("relative", 9).alias("relative"))


# --- policy and journal ----------------------------------------------------------------------

_BLOCKED = "b AS (SELECT DISTINCT user_id AS query_id, item_id FROM journal WHERE kind <> 'shown')"
_RET = f"{_CAT}, {_SCORED}, cand AS (SELECT query_id, item_id, score, rank FROM t WHERE rank <= 512)"


def _blocked(spark, sf_dir):
    return views.journal(spark, sf_dir).filter("kind <> 'shown'").select(F.col("user_id").alias("query_id"), "item_id").distinct()


@query(f"WITH {JOURNAL}, {_BLOCKED}, {_RET}, e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM cand ANTI JOIN b USING (query_id, item_id)) SELECT query_id, item_id, score, r AS rank FROM e WHERE r <= 10")
def eligible_topk(spark, sf_dir):
    cand = vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 512).drop("rank")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return cand.join(_blocked(spark, sf_dir), ["query_id", "item_id"], "left_anti").withColumn("rank", F.row_number().over(best)).filter("rank <= 10").select("query_id", "item_id", "score", "rank")


# event ids are unique here: a first shown counts, and each kind of outcome once, after it
_PROJ = """valid AS (SELECT * FROM (SELECT *, min(CASE WHEN kind = 'shown' THEN seq END) OVER (PARTITION BY user_id, item_id) AS s FROM journal) WHERE kind IN ('shown', 'save', 'dismiss', 'watched') AND (kind = 'shown' OR seq > s)),
acc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, kind ORDER BY seq) AS m FROM valid) WHERE m = 1),
proj AS (SELECT item_id, count(*) FILTER (WHERE kind = 'shown') AS shown, count(*) FILTER (WHERE kind = 'save') AS saved FROM acc GROUP BY 1)"""
_PILOT = f"""WITH {JOURNAL}, {_BLOCKED}, {_PROJ}, {_RET}, el AS (SELECT * FROM cand ANTI JOIN b USING (query_id, item_id)),
ti AS (SELECT query_id, CASE WHEN count(e.item_id) FILTER (WHERE e.rank <= 64) >= {{K}} THEN 64 WHEN count(e.item_id) FILTER (WHERE e.rank <= 128) >= {{K}} THEN 128 WHEN count(e.item_id) FILTER (WHERE e.rank <= 256) >= {{K}} THEN 256 ELSE 512 END AS tier, count(e.item_id) AS have FROM cand c LEFT JOIN el e USING (query_id, item_id) GROUP BY 1),
low AS (SELECT query_id, tier, have, min(score) AS low FROM cand JOIN ti USING (query_id) WHERE rank <= tier GROUP BY ALL),
pl AS (SELECT item_id, row_number() OVER (ORDER BY count(*) DESC, item_id) AS pop FROM journal GROUP BY 1), ni AS (SELECT count(*) AS n FROM embeddings),
inside AS (SELECT query_id, item_id, score, tier, 'retrieval' AS candidate_source FROM el JOIN ti USING (query_id) WHERE rank <= tier),
fill AS (SELECT query_id, pl.item_id, low - 1 - (pop - 1) / n AS score, tier, 'popular' AS candidate_source FROM low, pl, ni WHERE have < {{K}} AND NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = low.query_id AND b.item_id = pl.item_id) AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.query_id = low.query_id AND i.item_id = pl.item_id)),
sc AS (SELECT query_id, item_id, tier, candidate_source, round(score + coalesce(0.05 * saved / (shown + 2), 0), 6) AS score FROM (SELECT * FROM inside UNION ALL SELECT * FROM fill) LEFT JOIN proj USING (item_id)),
top AS (SELECT * FROM (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, score, candidate_source, tier FROM sc) WHERE rank <= {{K}})"""


def _pilot(spark, sf_dir, k=10):
    cand = vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 512)
    j = journal.accepted(views.journal(spark, sf_dir))
    popular = views.journal(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    popular = numbered(popular, "pop", F.desc("n"), F.col("item_id")).drop("n")
    return journal.selected(cand, _blocked(spark, sf_dir), journal.projection(j), popular, k, _catalog(spark, sf_dir).count())


@query(f"{_PILOT.replace('{K}', '10')} SELECT query_id, item_id, rank, score, tier FROM top WHERE candidate_source = 'retrieval'")
def pilot_rank(spark, sf_dir):
    return _pilot(spark, sf_dir).filter("candidate_source = 'retrieval'").drop("candidate_source")


@query(f"{_PILOT.replace('{K}', '520')} SELECT query_id, item_id, rank, score, candidate_source, tier FROM top")
def replenish_fill(spark, sf_dir):
    """Lists of 520, more than the largest tier retrieves, so the popularity fill takes part."""
    return _pilot(spark, sf_dir, 520)


@query(f"""WITH {JOURNAL}, s AS (SELECT user_id, item_id, bool_or(kind = 'save') AS saved, bool_or(kind = 'watched') AS watched, bool_or(kind = 'dismiss') AS dismissed FROM journal GROUP BY 1, 2)
SELECT user_id, item_id, p_name AS title, watched FROM s JOIN part ON p_partkey = item_id WHERE saved AND NOT dismissed AND p_size % 10 <> 0""")
def watchlist(spark, sf_dir):
    states = journal.item_states(views.journal(spark, sf_dir)).filter("saved and not dismissed")
    movies = table(spark, sf_dir, "part").filter("p_size % 10 <> 0").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return states.join(movies, "item_id").select("user_id", "item_id", "title", "watched")


_TWICE = """first AS (SELECT j.*, CASE WHEN a.seq IS NOT NULL THEN 'accepted' WHEN j.kind NOT IN ('shown', 'save', 'dismiss', 'watched') THEN 'unknown_kind' WHEN v.seq IS NULL THEN 'not_shown' ELSE 'conflict' END AS status FROM journal j LEFT JOIN acc a USING (seq) LEFT JOIN valid v USING (seq)),
again AS (SELECT f.*, f.event_id % 2 AS moved, EXISTS (SELECT 1 FROM acc a WHERE a.user_id = f.user_id AND a.item_id = f.item_id AND a.kind = 'shown') AS shown, EXISTS (SELECT 1 FROM acc a WHERE a.user_id = f.user_id AND a.item_id = f.item_id AND a.kind = f.kind) AS claimed FROM first f WHERE event_id % 10 < 2),
late AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, kind ORDER BY seq) AS m FROM again WHERE status <> 'accepted' AND kind IN ('shown', 'save', 'dismiss', 'watched') AND (kind = 'shown' OR shown) AND NOT claimed),
second AS (SELECT CASE WHEN kind NOT IN ('shown', 'save', 'dismiss', 'watched') THEN 'unknown_kind' WHEN status = 'accepted' AND moved = 0 THEN 'duplicate' WHEN status = 'accepted' THEN 'conflict' WHEN kind <> 'shown' AND NOT shown THEN 'not_shown' WHEN claimed THEN 'conflict' WHEN EXISTS (SELECT 1 FROM late l WHERE l.seq = a.seq AND l.m = 1) THEN 'accepted' ELSE 'conflict' END AS status FROM again a)"""


@query(f"WITH {JOURNAL}, {_PROJ}, {_TWICE} SELECT status, count(*) AS n FROM (SELECT status FROM first UNION ALL SELECT status FROM second) GROUP BY 1")
def journal_dedup_conflict(spark, sf_dir):
    j = views.journal(spark, sf_dir)
    again = j.filter("event_id % 10 < 2").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("event_time_ms", F.col("event_time_ms") + F.col("event_id") % 2)
    return journal.accepted(j.unionByName(again)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {JOURNAL}, {_PROJ} SELECT item_id, shown, saved FROM proj")
def journal_projection(spark, sf_dir):
    return journal.projection(journal.accepted(views.journal(spark, sf_dir)))


@query(f"""WITH {JOURNAL}, a AS (SELECT *, min(CASE WHEN kind = 'shown' THEN seq END) OVER (PARTITION BY user_id, item_id) AS s FROM journal)
SELECT kind, CASE WHEN kind NOT IN ('shown', 'save', 'dismiss', 'watched') THEN 'unknown_kind' WHEN kind <> 'shown' AND (s IS NULL OR s >= seq) THEN 'not_shown' ELSE 'ok' END AS reject, count(*) AS n FROM a GROUP BY 1, 2""")
def attribution_rejects(spark, sf_dir):
    return journal.attributed(views.journal(spark, sf_dir)).groupBy("kind", F.coalesce("reject", F.lit("ok")).alias("reject")).agg(F.count("*").alias("n"))


@query(f"""WITH {JOURNAL}, now AS (SELECT max(event_time_ms) AS t FROM journal) SELECT kind, count(*) AS n FROM journal, now WHERE event_time_ms >= t - CAST(10 * 86400000 AS BIGINT) GROUP BY 1""")
def retention_survivors(spark, sf_dir):
    j = views.journal(spark, sf_dir)
    now = j.agg(F.max("event_time_ms")).first()[0] or 0
    """Events within a retention of ten days (90 in service; the tables span less)."""
    return journal.survivors(j, now, dict.fromkeys(("shown", "save", "dismiss", "watched", "other"), 10)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {EVT} SELECT user_id, event_time_ms // 86400000 AS bucket, count(*) AS requests, count(*) - 1 AS rejected FROM evt GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit(spark, sf_dir):
    return journal.rate_limited(views.events(spark, sf_dir), 1, 86_400_000)


@query("SELECT p_partkey AS item_id, p_name AS title FROM part WHERE contains(lower(p_name), 'a') AND p_size % 10 <> 0 ORDER BY p_partkey LIMIT 20 OFFSET 20")
def search_page(spark, sf_dir):
    """The second page of 20 titles."""
    return table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") % 10 != 0)).select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")).orderBy("item_id").offset(20).limit(20)


# --- operations -------------------------------------------------------------------------------


@query("""SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_disc(value, 0.99), 6) AS nearest99, round(avg(value), 6) AS mean,
round(CASE WHEN count(value) < 2 OR avg(value) = 0 THEN 0 ELSE stddev_samp(value) / avg(value) END, 6) AS cv FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return operations.percentiles(table(spark, sf_dir, "events"), "value", "event_type")


@query("SELECT CAST(power(2, i) AS BIGINT) AS le, (SELECT count(*) FROM events WHERE value <= power(2, i)) AS cumulative FROM range(0, 18) r(i) UNION ALL SELECT NULL, count(value) FROM events")
def duration_histogram(spark, sf_dir):
    return operations.duration_histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT user_id % 10 AS cell, count(*) AS attempted, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS failed, round(1 - count(*) FILTER (WHERE event_type <> 'error') / count(*), 9) AS failure_rate FROM events GROUP BY 1")
def status_accounting(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("cell")).agg(F.count("*").alias("attempted"), F.count_if(F.expr("event_type <> 'error'")).alias("ok"), F.count_if(F.expr("event_type = 'error'")).alias("failed"), F.round(1 - F.count_if(F.expr("event_type <> 'error'")) / F.count("*"), 9).alias("failure_rate"))


@query("""WITH s AS (SELECT user_id % 50 AS cell, count(*) FILTER (WHERE event_type = 'error') / count(*) AS shed, quantile_cont(value, 0.99) AS p99, avg(value) AS feature, quantile_cont(value, 0.5) AS queue, avg(value) FILTER (WHERE event_type = 'click') AS score FROM events GROUP BY 1)
SELECT cell, CASE WHEN shed > 0.25 THEN 'overload' WHEN feature > score AND feature > 0.4 * p99 THEN 'feature_store_wait' WHEN queue > score AND queue > 0.4 * p99 THEN 'queueing' WHEN score > 0.5 * p99 THEN 'cpu_bound_scoring' ELSE 'unknown' END AS bottleneck FROM s""")
def diagnose_case(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy((F.col("user_id") % 50).alias("cell")).agg((F.count_if(F.expr("event_type = 'error'")) / F.count("*")).alias("shed"), F.percentile("value", 0.99).alias("p99"), F.avg("value").alias("feature"), F.percentile("value", 0.5).alias("queue"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("score"))
    return s.select("cell", operations.bottleneck(F.col("shed") - 0.2, F.lit(0.0), F.col("p99"), F.col("feature"), F.col("queue"), F.col("score")).alias("bottleneck"))


@query("""WITH t AS (SELECT user_id % 2 AS side, user_id % 20 AS trial, quantile_cont(value, 0.99) AS p99, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS recall, CAST(count(*) AS DOUBLE) AS qps FROM events GROUP BY 1, 2),
ok AS (SELECT count(DISTINCT side) = 2 AND bool_and(coalesce(isfinite(p99) AND p99 > 0 AND isfinite(qps) AND qps > 0 AND recall BETWEEN 0 AND 1, false)) AS sound FROM t),
g AS (SELECT median(p99) FILTER (WHERE side = 0) AS base_p99, median(p99) FILTER (WHERE side = 1) AS cand_p99, avg(recall) FILTER (WHERE side = 0) - avg(recall) FILTER (WHERE side = 1) AS "drop" FROM t)
SELECT round(base_p99, 6) AS base_p99, round(cand_p99, 6) AS cand_p99, round(cand_p99 / base_p99, 6) AS ratio, round("drop", 6) AS "drop", sound AND cand_p99 / base_p99 <= 1.25 AND "drop" <= 0.01 AS passed FROM g, ok""")
def regression_verdict(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 2).alias("side"), (F.col("user_id") % 20).alias("trial")).agg(F.percentile("value", 0.99).alias("p99"), (F.count_if(F.expr("event_type <> 'error'")) / F.count("*")).alias("recall"), F.count("*").cast("double").alias("qps"))
    return operations.regression_verdict(t.filter("side = 0"), t.filter("side = 1"))


_KERNELS = [("scalar", 1000.0, 256.0), ("simd", 2500.0, 256.0), ("int8", 4000.0, 68.0)]
_HOSTS = [("small", 8, 16.0, 0.29), ("large", 16, 32.0, 0.58), ("memory", 16, 128.0, 0.95)]


@query(f"""WITH k(kernel, r, bytes) AS (VALUES {', '.join(map(str, _KERNELS))}), h(instance, vcpu, mem, usd) AS (VALUES {', '.join(map(str, _HOSTS))}), q AS (SELECT CAST(count(*) AS DOUBLE) * 10 AS qps, (SELECT count(*) FROM part) * 50000.0 AS items FROM events),
c AS (SELECT kernel, instance, usd, qps, CAST(ceil(qps / (r * vcpu * 0.65)) AS BIGINT) AS compute_hosts, CAST(ceil(items * bytes * 3 / (mem * 1073741824.0 * 0.8)) AS BIGINT) AS memory_hosts FROM k, h, q), d AS (SELECT *, greatest(compute_hosts, memory_hosts) AS hosts FROM c)
SELECT kernel, instance, compute_hosts, memory_hosts, hosts, CASE WHEN memory_hosts > compute_hosts THEN 'memory' ELSE 'compute' END AS bound_by, round(hosts * usd, 6) AS usd_per_hour, round(hosts * usd / (qps * 3600) * 1e6, 9) AS usd_per_million FROM d""")
def cost_model(spark, sf_dir):
    qps, items = table(spark, sf_dir, "events").count() * 10.0, table(spark, sf_dir, "part").count() * 50_000.0
    return operations.capacity(spark.createDataFrame(_KERNELS, "kernel string, qps_per_core double, bytes_per_item double"), spark.createDataFrame(_HOSTS, "instance string, vcpu int, mem_gib double, usd_per_hour double"), qps, items, 3, 0.65)


@query(f"""WITH b AS (SELECT (epoch_us(ts) // 1000) // {6 * HOUR} AS bucket, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) AS total FROM events GROUP BY 1), m AS (SELECT *, (failures / total > 0.2 AND total >= 5)::INT AS bad FROM b)
SELECT bucket, round(failures / total, 6) AS ratio, sum(bad) OVER (ORDER BY bucket RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS firing FROM m""")
def alert_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / (6 * HOUR)).alias("bucket")).agg(F.count_if(F.expr("event_type = 'error'")).alias("failures"), F.count("*").alias("total"))
    return operations.held_alerts(e, 0.2, 5, 2)


@query("""WITH c AS (SELECT user_id AS thread, event_id AS id, (epoch_us(ts) // 1000) AS t_at, CASE event_type WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'call' END AS name FROM events),
n AS (SELECT *, sum((name = 'open')::INT) OVER w AS opened, coalesce(sum((name = 'close')::INT) OVER (PARTITION BY thread ORDER BY t_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM c WINDOW w AS (PARTITION BY thread ORDER BY t_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
i AS (SELECT *, max(CASE WHEN name = 'open' THEN closed END) OVER (PARTITION BY thread ORDER BY t_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM n WHERE opened > 0)
SELECT thread, CAST(closed AS BIGINT) AS episode, min(CASE WHEN name = 'open' THEN t_at END) AS "begin", max(CASE WHEN name = 'close' THEN t_at END) AS "end", count(*) AS n_calls FROM i WHERE closed = since GROUP BY 1, 2 HAVING max(CASE WHEN name = 'close' THEN t_at END) IS NOT NULL""")
def trace_episodes(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "open").when(F.col("event_type") == "purchase", "close").otherwise("call")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), name.alias("name"))
    return operations.episodes(calls)



# --- campaigns and traces ---------------------------------------------------------------------

_RUNS = "runs AS (SELECT user_id % 5 AS config, user_id % 40 AS run, quantile_cont(value, 0.99) AS p99, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS recall, count(*) AS attempted, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2)"


def _runs(spark, sf_dir):
    """Latency runs of five configurations, from the events of each user group."""
    e = table(spark, sf_dir, "events")
    failed = F.count_if(F.expr("event_type = 'error'"))
    return e.groupBy((F.col("user_id") % 5).alias("config"), (F.col("user_id") % 40).alias("run")).agg(F.percentile("value", 0.99).alias("p99"), (1 - failed / F.count("*")).alias("recall"), F.count("*").alias("attempted"), failed.alias("failed"))


@query(f"WITH {_RUNS} SELECT config, count(*) AS runs, round(avg(p99), 6) AS mean, round(stddev_samp(p99), 6) AS sd, round(stddev_samp(p99) / sqrt(count(*)), 6) AS sem, round(stddev_samp(p99) / avg(p99), 6) AS cv, round(2 * sqrt(2) * stddev_samp(p99) / avg(p99), 6) AS detect_floor FROM runs GROUP BY 1")
def run_calibration(spark, sf_dir):
    c = campaigns.calibration(_runs(spark, sf_dir), "p99", "config")
    return c.select("config", "runs", *(F.round(x, 6).alias(x) for x in ("mean", "sd", "sem", "cv", "detect_floor")))


@query("""WITH c AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS cum, count(value) AS n FROM events, (SELECT CAST(power(2, i) AS BIGINT) AS le FROM range(0, 18) r(i)) GROUP BY 1, 2)
SELECT event_type, max(n) AS n, (SELECT round(avg(value), 6) FROM events e WHERE e.event_type = c.event_type) AS mean, min(le) FILTER (WHERE cum >= ceil(n * 0.99)) AS upper, max(n) - max(cum) AS overflow FROM c GROUP BY 1""")
def histogram_bounds(spark, sf_dir):
    found = campaigns.bucket_bounds(table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.col("upper").cast("long").alias("upper"), "overflow")


@query(f"WITH {_RUNS} SELECT config, CAST(sum(attempted) AS BIGINT) AS attempted, CAST(sum(failed) AS BIGINT) AS failed, round(min(p99), 6) AS least_p99, round(max(p99), 6) AS most_p99, count(*) AS runs FROM runs GROUP BY 1")
def campaign_summary(spark, sf_dir):
    return campaigns.summary(_runs(spark, sf_dir), ["config"]).withColumn("least_p99", F.round("least_p99", 6)).withColumn("most_p99", F.round("most_p99", 6))


@query(f"""WITH {_RUNS}, m AS (SELECT run % 4 AS items, config, median(p99) AS p99, min(recall) AS least_recall FROM runs GROUP BY 1, 2)
SELECT items, config, round(p99, 6) AS p99, round(least_recall, 6) AS least_recall, round(b.p, 6) AS base_p99, round(p99 / b.p, 6) AS ratio FROM m LEFT JOIN (SELECT items, p99 AS p FROM m WHERE config = 0) b USING (items)""")
def campaign_medians(spark, sf_dir):
    m = campaigns.medians(_runs(spark, sf_dir).withColumn("items", F.col("run") % 4), ["items", "config"], F.col("config") == 0)
    return m.select("items", "config", *(F.round(c, 6).alias(c) for c in ("p99", "least_recall", "base_p99", "ratio")))


@query("""WITH r AS (SELECT event_id // 8 AS request, max(value) AS s, min(value) AS f FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS requests, round(quantile_cont(value, 0.99), 6) AS shard_p99, (SELECT round(quantile_cont(s, 0.99), 6) FROM r) AS e2e_p99, (SELECT round(quantile_cont(f, 0.5), 6) FROM r) AS fastest_p50, round((SELECT quantile_cont(s, 0.99) FROM r) / quantile_cont(value, 0.99), 6) AS tail_amplification FROM events""")
def shard_tails(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 8).alias("request"), (F.col("event_id") % 8).alias("shard"), F.col("value").alias("us"))
    return campaigns.scatter_gather(calls).select("requests", *(F.round(c, 6).alias(c) for c in ("shard_p99", "e2e_p99", "fastest_p50", "tail_amplification")))


@query(f"WITH {_RUNS} SELECT config, min(run) FILTER (WHERE recall >= 0.9) AS first, round(max(recall), 9) AS best FROM runs GROUP BY 1")
def sweep_first(spark, sf_dir):
    return campaigns.first_reaching(_runs(spark, sf_dir), "config", "run", "recall", 0.9).withColumn("best", F.round("best", 9))


_SNAP = "snap AS (SELECT user_id % 50 AS cell, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.9) AS retrieve, avg(value) AS score, quantile_cont(value, 0.5) AS feature, stddev_samp(value) / avg(value) AS cv, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS recall FROM events GROUP BY 1)"


@query(f"""WITH {_SNAP}, r AS (SELECT cell, 0 AS i, 'retrieve_dominates' AS hypothesis, least(1.0, retrieve / p99) AS confidence, CASE WHEN recall - 0.8 > 0.01 THEN 'ef' ELSE 'kernel' END AS action FROM snap WHERE retrieve > 0.5 * p99
UNION ALL SELECT cell, 1, 'scoring_dominates', least(1.0, score / p99), 'retrieve_k' FROM snap WHERE score > 0.35 * p99 UNION ALL SELECT cell, 2, 'feature_store_wait', least(1.0, feature / p99), 'kernel' FROM snap WHERE feature > 0.25 * p99
UNION ALL SELECT cell, 3, 'measurement_unstable', least(1.0, cv), 'pin' FROM snap WHERE cv > 0.20 UNION ALL SELECT cell, 4, 'recall_headroom', least(1.0, (recall - 0.8) * 4), 'ef' FROM snap WHERE recall - 0.8 > 0.05 UNION ALL SELECT cell, 5, 'recall_violation', 1.0, 'ef' FROM snap WHERE recall - 0.8 < 0)
SELECT cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY confidence DESC, i) AS INTEGER) AS rank, hypothesis, round(confidence, 6) AS confidence, action FROM r""")
def ranked_diagnosis(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    snap = e.groupBy((F.col("user_id") % 50).alias("cell")).agg(F.percentile("value", 0.99).alias("p99"), F.percentile("value", 0.9).alias("retrieve"), F.avg("value").alias("score"), F.percentile("value", 0.5).alias("feature"), (F.stddev_samp("value") / F.avg("value")).alias("cv"), (F.count_if(F.expr("event_type <> 'error'")) / F.count("*")).alias("recall"))
    return campaigns.hypotheses(snap, 0.8).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_RUNS}, s AS (SELECT config, stddev_samp(p99) / 20 AS sigma FROM runs GROUP BY 1), b AS (SELECT config, max(p99) AS best_p99 FROM runs GROUP BY 1)
SELECT config * 100 + run AS cell, CASE WHEN recall < 0.85 THEN 'recall' WHEN attempted > 400 THEN 'memory' WHEN best_p99 - p99 <= 2 * sqrt(2) * sigma THEN 'noise' ELSE 'accepted' END AS verdict FROM runs JOIN s USING (config) JOIN b USING (config)""")
def accept_gate(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    base = runs.groupBy("config").agg((F.stddev_samp("p99") / 20).alias("sigma"), F.max("p99").alias("best_p99"))
    pairs = runs.join(base, "config").select((F.col("config") * 100 + F.col("run")).alias("cell"), "best_p99", "p99", "sigma", "recall", F.col("attempted").alias("rss"))
    return campaigns.accepted(pairs, 0.85, 400)


@query(f"WITH {_RUNS} SELECT config * 100 + run AS cell, failed / attempted <= 0.21 AND p99 <= 150 AS passed FROM runs")
def slo_verdict(spark, sf_dir):
    r = _runs(spark, sf_dir).select((F.col("config") * 100 + F.col("run")).alias("cell"), (F.col("failed") / F.col("attempted")).alias("failure_rate"), "p99")
    return campaigns.slo(r, 0.21, 150.0).select("cell", "passed")


@query(f"""WITH k(kernel, r, bytes) AS (VALUES {', '.join(map(str, _KERNELS))}), h(instance, vcpu, mem, usd) AS (VALUES {', '.join(map(str, _HOSTS))}), q AS (SELECT CAST(count(*) AS DOUBLE) * 10 AS qps, (SELECT count(*) FROM part) * 50000.0 AS items FROM events),
c AS (SELECT kernel, instance, round(greatest(ceil(qps / (r * vcpu * 0.65)), ceil(items * bytes * 3 / (mem * 1073741824.0 * 0.8))) * usd, 6) AS usd FROM k, h, q) SELECT a.kernel, a.instance, b.usd AS base_usd, a.usd AS usd_per_hour, round(1 - a.usd / b.usd, 6) AS saved FROM c a JOIN c b ON a.instance = b.instance AND b.kernel = 'scalar' WHERE a.kernel <> 'scalar'""")
def cost_savings(spark, sf_dir):
    return campaigns.savings(cost_model(spark, sf_dir), "scalar").withColumn("saved", F.round("saved", 6))


@query("SELECT user_id AS fingerprint FROM events GROUP BY 1 HAVING bool_or(event_type = 'error') AND bool_or(event_type <> 'error')")
def retried_alerts(spark, sf_dir):
    return campaigns.retried(table(spark, sf_dir, "events").select(F.col("user_id").alias("fingerprint"), (F.col("event_type") != "error").alias("accepted")))


@query("SELECT user_id AS fingerprint, (epoch_us(ts) // 86400000000) AS starts_at FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 2")
def recovered_alerts(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "firing").when(F.col("event_type") == "view", "resolved")
    alerts = table(spark, sf_dir, "events").select(F.col("user_id").alias("fingerprint"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86_400_000).alias("starts_at"), state.alias("status"))
    return campaigns.recovered(alerts)


@query("""WITH s AS (SELECT user_id % 20 AS series, event_id AS pos, value FROM events), d AS (SELECT series, pos, value, lag(value) OVER (PARTITION BY series ORDER BY pos) AS b FROM s)
SELECT series, pos // 1000 AS bucket, round(sum(CASE WHEN b IS NULL THEN 0 WHEN value >= b THEN value - b ELSE value END), 4) AS increase FROM d GROUP BY 1, 2""")
def counter_increase(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("series"), F.col("event_id").alias("at"), "value")
    return campaigns.increases(samples, 1000).withColumn("increase", F.round("increase", 4))


_CALLS = """names(id, value) AS (VALUES (0, 'copyAsync'), (1, 'launch'), (2, 'synchronize'), (3, 'range')),
raw AS (SELECT user_id AS thread, event_id AS start, event_id + 1 AS "end", event_id AS correlation, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 9 END AS name_id FROM events),
calls AS (SELECT raw.* EXCLUDE (name_id), value AS name FROM raw JOIN names ON id = name_id),
n AS (SELECT *, coalesce(sum((name = 'synchronize')::INT) OVER (PARTITION BY thread ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM calls),
o AS (SELECT *, max((name = 'copyAsync')::INT) OVER (PARTITION BY thread, episode ORDER BY start) AS opened FROM n),
inside AS (SELECT * FROM (SELECT *, min(start) OVER w AS "begin", max(CASE WHEN name = 'synchronize' THEN "end" END) OVER w AS until FROM o WHERE opened = 1 WINDOW w AS (PARTITION BY thread, episode)) WHERE until IS NOT NULL)"""


def _inside(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 1).otherwise(9)
    raw = e.select(F.col("user_id").alias("thread"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"), F.col("event_id").alias("correlation"), name.alias("name_id"))
    names = spark.createDataFrame([(0, "copyAsync"), (1, "launch"), (2, "synchronize"), (3, "range")], "id int, value string")
    return traces.episodes(traces.named(raw, names), "copyAsync", "synchronize")


@query(f"WITH {_CALLS} SELECT thread, CAST(episode AS BIGINT) AS episode, max(until) - min(\"begin\") AS duration, count(*) AS calls FROM inside GROUP BY 1, 2")
def trace_intervals(spark, sf_dir):
    return _inside(spark, sf_dir).groupBy("thread", "episode").agg((F.max("until") - F.min("begin")).alias("duration"), F.count("*").alias("calls"))


@query(f"""WITH {_CALLS}, k AS (SELECT event_id AS correlation, event_id + (event_id % 3) AS s, event_id + (event_id % 3) + 1 AS e FROM events)
SELECT thread, CAST(episode AS BIGINT) AS episode, count(*) AS kernels, CAST(sum(e - s) AS BIGINT) AS busy, count(*) FILTER (WHERE s < "begin" OR e > until) AS outside FROM inside JOIN k USING (correlation) GROUP BY 1, 2""")
def trace_kernels(spark, sf_dir):
    late = F.col("event_id") + F.col("event_id") % 3
    kernels = table(spark, sf_dir, "events").select(F.col("event_id").alias("correlation"), late.alias("start"), (late + 1).alias("end"))
    return traces.device_work(_inside(spark, sf_dir), kernels)


@query(f"""WITH {_CALLS}, r AS (SELECT user_id AS thread, event_id AS s, event_id + 200 AS e, event_type AS name FROM events), ep AS (SELECT thread, episode, min("begin") AS b, max(until) AS u FROM inside GROUP BY 1, 2)
SELECT thread, CAST(episode AS BIGINT) AS episode, name, s - b AS "offset", e - s AS duration FROM r JOIN ep USING (thread) WHERE s >= b AND e <= u""")
def trace_ranges(spark, sf_dir):
    ranges = table(spark, sf_dir, "events").select(F.col("user_id").alias("thread"), F.col("event_id").alias("start"), (F.col("event_id") + 200).alias("end"), F.col("event_type").alias("name"))
    return traces.contained(_inside(spark, sf_dir), ranges)


@query(f"WITH {JOURNAL}, {_PROJ} SELECT count(*) AS generation, max(event_time_ms) AS last_event_ms FROM acc")
def journal_generation(spark, sf_dir):
    return journal.generation(journal.accepted(views.journal(spark, sf_dir)))


from marlstone import serving_queries  # noqa: E402,F401  registers its queries here
