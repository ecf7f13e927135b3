"""Queries of the serving policy and of the nearline path, each over the tables of one folder; ``marlstone.queries`` holds the registry."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import rules
from marlstone.operators import graphs, journal, policy, vectors
from marlstone.operators.tables import numbered, remove, shared_folder, written
from marlstone.plans import views
from marlstone.plans.views import EVT, INTER, JOURNAL, table
from marlstone.queries import _RET, HOUR, _catalog, _query_set, query
from marlstone.sources import reports
from marlstone.streaming import nearline
from marlstone.streaming.ctr_stream import windowed_ctr

DAY = 24 * HOUR

# --- eligibility and lists -------------------------------------------------------------------

_STATES = "st AS (SELECT user_id, item_id, bool_or(kind = 'save') AS saved, bool_or(kind = 'watched') AS watched, bool_or(kind = 'dismiss') AS dismissed FROM journal GROUP BY 1, 2)"
_PREFS = 'prefs AS (SELECT "user" AS user_id, item AS item_id FROM inter WHERE rating >= 4.5 OR rating <= 1)'
_BOTH = f"{JOURNAL}, {INTER}, {_STATES}, {_PREFS}, bl AS (SELECT user_id, item_id FROM prefs UNION SELECT user_id, item_id FROM st WHERE saved OR watched OR dismissed)"


def _blocked(spark, sf_dir):
    prefs = views.interactions(spark, sf_dir).filter("rating >= 4.5 or rating <= 1").select(F.col("user").alias("user_id"), F.col("item").alias("item_id"))
    return policy.blocked(prefs, journal.item_states(views.journal(spark, sf_dir)))


@query(f"WITH {_BOTH} SELECT user_id, count(*) AS blocked, count(DISTINCT item_id) AS items FROM bl GROUP BY 1")
def blocked_union(spark, sf_dir):
    return _blocked(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("blocked"), F.count_distinct("item_id").alias("items"))


@query(f"""WITH {_BOTH}, cand AS (SELECT DISTINCT user_id, item_id FROM journal)
SELECT user_id, item_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i."user" = c.user_id AND i.item = c.item_id) AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.user_id = c.user_id AND bl.item_id = c.item_id) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = c.item_id AND p_size % 10 = 0)""")
def eligible_pairs(spark, sf_dir):
    trained = views.interactions(spark, sf_dir).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"))
    gone = table(spark, sf_dir, "part").filter("p_size % 10 = 0").select(F.col("p_partkey").alias("item_id"))
    return policy.eligible(views.journal(spark, sf_dir).select("user_id", "item_id").distinct(), trained, _blocked(spark, sf_dir), gone)


_LISTS = f"""{JOURNAL}, {_RET}, bl AS (SELECT DISTINCT user_id AS query_id, item_id FROM journal WHERE kind IN ('save', 'watched', 'dismiss')),
ask AS (SELECT vec_id AS query_id, CASE (vec_id // 100) % 4 WHEN 2 THEN 'cold' WHEN 3 THEN 'failed' ELSE 'ready' END AS state FROM embeddings WHERE vec_id % 100 = 0),
taken AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM cand JOIN ask USING (query_id) WHERE state = 'ready' AND item_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.query_id = cand.query_id AND bl.item_id = cand.item_id)),
ten AS (SELECT * FROM taken WHERE rank <= 480),
pl AS (SELECT item_id, count(*) AS n FROM journal GROUP BY 1),
fill AS (SELECT a.query_id, p.item_id, (SELECT count(*) FROM ten t WHERE t.query_id = a.query_id) + row_number() OVER (PARTITION BY a.query_id ORDER BY n DESC, p.item_id) AS rank FROM ask a, pl p JOIN embeddings v ON v.vec_id = p.item_id AND v.vec_id % 10 <> 0 WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.query_id = a.query_id AND bl.item_id = p.item_id) AND NOT EXISTS (SELECT 1 FROM ten t WHERE t.query_id = a.query_id AND t.item_id = p.item_id)),
got AS (SELECT query_id, item_id, rank, 'als' AS source FROM ten UNION ALL SELECT query_id, item_id, rank, 'popularity' FROM fill WHERE rank <= 480)"""


@query(f"WITH {_LISTS} SELECT a.query_id, g.rank, g.item_id, g.source, CASE WHEN a.state = 'ready' THEN 'als' ELSE 'popularity' END AS candidate_source, a.state = 'failed' AS degraded, count(g.item_id) OVER (PARTITION BY a.query_id) < 480 AS exhausted FROM ask a LEFT JOIN got g USING (query_id)")
def select_lists(spark, sf_dir):
    """Lists of 480, so that some need the fill and some stay short."""
    state = F.when(F.floor(F.col("query_id") / 100) % 4 == 2, "cold").when(F.floor(F.col("query_id") / 100) % 4 == 3, "failed").otherwise("ready")
    asked = _query_set(spark, sf_dir).select("query_id", state.alias("state"))
    cand = vectors.top_k(_query_set(spark, sf_dir), _catalog(spark, sf_dir), 512)
    gone = views.journal(spark, sf_dir).filter("kind in ('save', 'watched', 'dismiss')").select(F.col("user_id").alias("query_id"), "item_id")
    catalog = _catalog(spark, sf_dir).select("item_id", (F.col("item_id") % 10 != 0).alias("available"))
    popular = views.journal(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return policy.select_items(asked, cand, gone, catalog, numbered(popular, "pop", F.desc("n"), F.col("item_id")), 480, "als")


@query("WITH v AS (SELECT * FROM (SELECT user_id, event_id, json_extract_string(props, '$.k') AS item, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id) AS m FROM events) WHERE m = 1) SELECT user_id, CAST(item AS BIGINT) AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM v")
def lists_without_repeats(spark, sf_dir):
    rows = policy.first_of_each(views.events(spark, sf_dir), "user_id", "item_id", "event_id")
    return rows.select("user_id", "item_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("place"))


# --- bounds, names and records ---------------------------------------------------------------


@query("SELECT CASE WHEN k NOT BETWEEN 1 AND 50 THEN 'bad_k' WHEN r NOT BETWEEN 1 AND 65536 THEN 'bad_retrieve' WHEN t <= 0 THEN 'bad_timeout' ELSE 'ok' END AS fault, count(*) AS n FROM (SELECT o_orderkey % 60 AS k, o_custkey * 700 AS r, o_orderkey % 7 AS t FROM orders) GROUP BY 1")
def request_bounds(spark, sf_dir):
    fault = rules.request_fault(F.col("o_orderkey") % 60, F.col("o_custkey") * 700, F.col("o_orderkey") % 7, "pilot")
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(fault, F.lit("ok")).alias("fault")).agg(F.count("*").alias("n"))


@query(f"""WITH {EVT}, r AS (SELECT event_id AS seq, user_id, item_id % 20 AS request_id, event_id % 3 // 2 AS k, event_time_ms AS at_ms FROM evt), f AS (SELECT user_id, request_id, min(seq) AS s FROM r GROUP BY 1, 2)
SELECT r.seq, CASE WHEN r.seq = s THEN 'computed' WHEN r.k = o.k AND r.at_ms - o.at_ms < {DAY} THEN 'stored' ELSE 'conflict' END AS status FROM r JOIN f USING (user_id, request_id) JOIN r o ON o.seq = f.s""")
def issued_requests(spark, sf_dir):
    r = views.events(spark, sf_dir).select(F.col("event_id").alias("seq"), "user_id", (F.col("item_id") % 20).alias("request_id"), F.floor(F.col("event_id") % 3 / 2).alias("k"), F.col("event_time_ms").alias("at_ms"))
    return policy.issued_requests(r).select("seq", "status")


@query(r"""WITH u AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN upper(md5(url)) ELSE md5(url) END AS h FROM pages), i AS (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id FROM u)
SELECT page_id, id, coalesce(regexp_full_match(id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'), false) AS is_uuid, coalesce(length(url) BETWEEN 1 AND 128 AND NOT regexp_matches(url, '[\x00-\x20]'), false) AS is_identifier, lower(upper(url)) AS folded FROM i""")
def identifier_rules(spark, sf_dir):
    h = F.when(F.col("page_id") % 3 == 0, F.upper(F.md5("url"))).otherwise(F.md5("url"))
    cut = F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return table(spark, sf_dir, "pages").withColumn("id", cut).select("page_id", "id", rules.is_uuid(F.col("id")).alias("is_uuid"), rules.is_identifier(F.col("url")).alias("is_identifier"), rules.folded(F.upper("url")).alias("folded"))


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":' || coalesce('"' || nullif(c_mktsegment, 'BUILDING') || '"', 'null') || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' AS payload, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS digest FROM customer""")
def canonical_json(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return c.select("c_custkey", rules.canonical(["c_nationkey", "c_name", "c_custkey", "c_mktsegment"]).alias("payload"), F.sha2(rules.canonical(["c_name", "c_custkey"]), 256).alias("digest"))


@query("""WITH s AS (SELECT CASE event_id % 8 WHEN 0 THEN '55P03' WHEN 1 THEN '57014' WHEN 2 THEN '40001' WHEN 3 THEN '40P01' WHEN 4 THEN '08006' WHEN 5 THEN '23505' END AS state, event_type = 'error' AS gone, user_id % 10 = 0 AS pool FROM events)
SELECT CASE WHEN pool THEN 'pool_timeout' WHEN state = '55P03' THEN 'lock_timeout' WHEN state = '57014' THEN 'query_cancelled' WHEN state = '40001' THEN 'serialization' WHEN state = '40P01' THEN 'deadlock' WHEN gone OR state LIKE '08%' THEN 'connection' ELSE 'other' END AS reason, count(*) AS n FROM s GROUP BY 1""")
def failure_reasons(spark, sf_dir):
    codes = F.array(*(F.lit(c) for c in ("55P03", "57014", "40001", "40P01", "08006", "23505", None, None)))
    state = F.element_at(codes, (F.col("event_id") % 8 + 1).cast("int"))
    reason = rules.failure_reason(state, F.col("event_type") == "error", F.col("user_id") % 10 == 0)
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT p_partkey AS item_id, p_name || ' (19' || (10 + p_size) || ')' AS title, [p_type, '(no genres listed)', p_brand, p_name] AS g FROM part)
SELECT item_id, regexp_replace(title, '\\s*\\(\\d{4}\\)$', '') AS title, g[1] || ' / ' || g[3] AS genres FROM t""")
def display_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" (19"), (F.col("p_size") + 10).cast("string"), F.lit(")"))
    return p.select(F.col("p_partkey").alias("item_id"), rules.plain_title(title).alias("title"), rules.genre_label(F.array("p_type", F.lit(rules.NO_GENRES), "p_brand", "p_name")).alias("genres"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, count(*) AS displayed FROM events WHERE (event_id % 100) / 100.0 >= 0.5 AND value * 100 >= 800 GROUP BY 1")
def displayed_impressions(spark, sf_dir):
    shares = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item_id"), (F.col("event_id") % 100 / 100.0).alias("visible_share"), (F.col("value") * 100).alias("visible_ms"))
    return policy.displayed(shares).groupBy("item_id").agg(F.count("*").alias("displayed"))


@query(f"WITH {JOURNAL} SELECT item_id, arg_max(kind = 'dismiss', seq) AS unavailable, count(*) AS changes FROM journal GROUP BY 1")
def availability_toggles(spark, sf_dir):
    return policy.availability(views.journal(spark, sf_dir).withColumn("value", F.col("kind") == "dismiss"))


@query("SELECT sha256(html) AS digest, min(page_id) AS seq, arg_min(url, page_id) AS name FROM pages WHERE html IS NOT NULL GROUP BY 1")
def model_registry(spark, sf_dir):
    p = table(spark, sf_dir, "pages").filter("html is not null")
    return policy.registered(p.select(F.sha2("html", 256).alias("digest"), F.col("page_id").alias("seq"), F.col("url").alias("name")))


_OUTBOX = "o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'export' END AS kind, o_custkey AS user_id, epoch_us(o_orderdate) // 1000 AS created_ms, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS delivered_ms FROM orders)"


def _outbox(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "delete").otherwise("export")
    sent = F.when(F.col("o_orderkey") % 2 == 0, 1).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_custkey").alias("user_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"), sent.alias("delivered_ms"))


@query(f"WITH {_OUTBOX} SELECT id, kind, CASE WHEN kind = 'delete' AND delivered_ms IS NULL THEN 77 ELSE delivered_ms END AS delivered_ms FROM o")
def outbox_delivery(spark, sf_dir):
    return policy.delivered(_outbox(spark, sf_dir), 77)[1].select("id", "kind", "delivered_ms")


@query(f"WITH {JOURNAL}, {_OUTBOX} SELECT user_id, count(*) AS n FROM journal WHERE user_id NOT IN (SELECT user_id FROM o WHERE kind = 'delete' AND delivered_ms IS NULL) GROUP BY 1")
def deletion_replay(spark, sf_dir):
    """What a restore leaves of the journal once the ledger of pending deletions is replayed."""
    from marlstone.operators.accounts import without_deleted

    ledger, _ = policy.delivered(_outbox(spark, sf_dir), 77)
    return without_deleted({"journal": views.journal(spark, sf_dir)}, ledger)["journal"].groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return policy.repeated(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query(f"WITH {JOURNAL}, a AS (SELECT DISTINCT item_id FROM journal) SELECT coalesce(item_id, vec_id) AS item_id, CASE WHEN vec_id IS NULL THEN 1 ELSE 0 END AS only_left, CASE WHEN item_id IS NULL THEN 1 ELSE 0 END AS only_right FROM a FULL JOIN embeddings ON item_id = vec_id WHERE item_id IS NULL OR vec_id IS NULL")
def permutation_check(spark, sf_dir):
    return policy.not_shared(views.journal(spark, sf_dir).select("item_id").distinct(), _catalog(spark, sf_dir), "item_id")


@query("SELECT c_custkey, c_mktsegment AS fingerprint FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def fingerprint_binding(spark, sf_dir):
    return policy.bound(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("fingerprint")), "BUILDING")


# --- sessions and the journal with impressions -------------------------------------------------

_NOW = 1_705_000_000_000


@query(f"""WITH {EVT}, s AS (SELECT event_id, user_id, event_time_ms AS created_ms, event_time_ms + item_id * {HOUR} AS seen_ms FROM evt)
SELECT event_id, user_id FROM s JOIN customer ON c_custkey = user_id WHERE c_acctbal >= 0 AND created_ms > {_NOW - 7 * DAY} AND seen_ms > {_NOW - DAY}""")
def valid_sessions(spark, sf_dir):
    s = views.events(spark, sf_dir).select("event_id", "user_id", F.col("event_time_ms").alias("created_ms"), (F.col("event_time_ms") + F.col("item_id") * HOUR).alias("seen_ms"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") < 0).alias("disabled"))
    return journal.valid_sessions(s, users, _NOW).select("event_id", "user_id")


@query(f"""WITH {EVT}, s AS (SELECT event_time_ms AS created_ms, event_time_ms + item_id * {HOUR} AS seen_ms, event_time_ms // 60000 AS w, CASE WHEN type = 1 THEN 1 END AS d FROM evt)
SELECT 'oauth_flows' AS name, count(*) AS n FROM s WHERE created_ms >= {_NOW - 600_000} UNION ALL SELECT 'outbox', count(*) FROM s WHERE d IS NULL OR created_ms >= {_NOW - 8 * DAY} UNION ALL SELECT 'rate_limits', count(*) FROM s WHERE w >= {_NOW // 60_000 - 2} UNION ALL SELECT 'sessions', count(*) FROM s WHERE created_ms >= {_NOW - 7 * DAY} AND seen_ms >= {_NOW - DAY}""")
def maintenance(spark, sf_dir):
    e = views.events(spark, sf_dir)
    at = F.col("event_time_ms").alias("created_ms")
    kept = journal.maintained({"oauth_flows": e.select(at), "outbox": e.select(at, F.when(F.col("type") == 1, 1).alias("delivered_ms")), "rate_limits": e.select(F.floor(F.col("event_time_ms") / 60_000).alias("window")), "sessions": e.select(at, (F.col("event_time_ms") + F.col("item_id") * HOUR).alias("seen_ms"))}, _NOW)
    found = None
    for name, left in kept.items():
        one = left.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


# a request per user and day's third; items divisible by 5 were not issued; an even request was made late
_ISSUED = f"""ev AS (SELECT *, user_id * 1000 + event_time_ms // {10 * DAY} % 3 AS request_id, event_time_ms + (event_id % 27) * {HOUR} AS received_ms FROM journal),
imp AS (SELECT request_id, min(user_id) AS user_id, min(event_time_ms) + CASE WHEN request_id % 2 = 0 THEN {DAY} ELSE 0 END AS created_ms FROM ev GROUP BY 1),
ex AS (SELECT DISTINCT request_id, item_id FROM ev WHERE item_id % 5 <> 0),
lt AS (SELECT e.*, kind IN ('shown', 'save', 'dismiss', 'watched') AS known, CASE WHEN received_ms - event_time_ms > {DAY} THEN 'expired' WHEN x.item_id IS NULL THEN 'not_issued' WHEN event_time_ms < created_ms - 30000 THEN 'too_early' END AS late FROM ev e LEFT JOIN ex x USING (request_id, item_id) LEFT JOIN imp i USING (request_id)),
sh AS (SELECT request_id, item_id, min(seq) AS s FROM lt WHERE known AND late IS NULL AND kind = 'shown' GROUP BY 1, 2),
fi AS (SELECT request_id, item_id, kind, min(seq) AS f FROM lt LEFT JOIN sh USING (request_id, item_id) WHERE known AND late IS NULL AND (kind = 'shown' OR seq > s) GROUP BY 1, 2, 3),
app AS (SELECT l.*, CASE WHEN NOT known THEN 'unknown_kind' WHEN late IS NOT NULL THEN late WHEN kind <> 'shown' AND (s IS NULL OR seq < s) THEN 'not_shown' WHEN seq = f THEN 'accepted' ELSE 'conflict' END AS status FROM lt l LEFT JOIN sh USING (request_id, item_id) LEFT JOIN fi USING (request_id, item_id, kind))"""


def _issued(spark, sf_dir):
    e = views.journal(spark, sf_dir).withColumn("request_id", F.col("user_id") * 1000 + F.floor(F.col("event_time_ms") / (10 * DAY)) % 3).withColumn("received_ms", F.col("event_time_ms") + F.col("event_id") % 27 * HOUR)
    late = F.when(F.col("request_id") % 2 == 0, F.lit(DAY)).otherwise(F.lit(0))
    imp = e.groupBy("request_id").agg(F.min("user_id").alias("user_id"), F.min("event_time_ms").alias("t")).select("request_id", "user_id", (F.col("t") + late).alias("created_ms"))
    responses = e.filter("item_id % 5 <> 0").groupBy("request_id").agg(F.collect_set("item_id").alias("items"))
    return e, imp, journal.exposures(responses)


@query(f"WITH {JOURNAL}, {_ISSUED} SELECT seq, status FROM app")
def journal_apply(spark, sf_dir):
    return journal.accepted(*_issued(spark, sf_dir)).select("seq", "status")


@query(f"WITH {JOURNAL}, {_ISSUED} SELECT item_id, count(*) FILTER (WHERE kind = 'shown') AS shown, count(*) FILTER (WHERE kind = 'save') AS saved, 0 AS moved FROM app WHERE status = 'accepted' GROUP BY 1")
def journal_replay_equals_projection(spark, sf_dir):
    """The projection, with how far it moves when the accepted rows are applied once more: by nothing."""
    e, imp, ex = _issued(spark, sf_dir)
    once = journal.accepted(e, imp, ex)
    again = journal.accepted(once.filter("status = 'accepted'").drop("status"), imp, ex)
    b = journal.projection(again).select("item_id", F.col("shown").alias("s2"), F.col("saved").alias("v2"))
    moved = F.abs(F.col("shown") - F.coalesce("s2", F.lit(0))) + F.abs(F.col("saved") - F.coalesce("v2", F.lit(0)))
    return journal.projection(once).join(b, "item_id", "left").select("item_id", "shown", "saved", moved.cast("int").alias("moved"))


@query(f"WITH {JOURNAL}, {_ISSUED} SELECT request_id, count(*) AS items FROM ex GROUP BY 1")
def exposures(spark, sf_dir):
    return _issued(spark, sf_dir)[2].groupBy("request_id").agg(F.count("*").alias("items"))


# --- nearline ----------------------------------------------------------------------------------


def _stream(spark, sf_dir, view):
    """``view`` over a stream of the events table."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return view(raw)


def _records(e):
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_time_ms"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), (F.col("event_type") == "purchase").cast("int").alias("type"))


def _latest(spark, stream, mode, key):
    """Run ``stream`` to its end; of each ``key`` the row of the last batch."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    nearline.drained(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{at}/rows/batch={n}"), f"{at}/state", mode)
    remove(spark, f"{at}/state")
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{at}/rows")
    last = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "batch")


@query(f"WITH {EVT} SELECT item_id, event_time_ms - event_time_ms % {HOUR} AS window_start_ms, count(*) AS views, CAST(sum(type) AS BIGINT) AS likes FROM evt GROUP BY 1, 2")
def stream_ctr(spark, sf_dir):
    """The hourly rates once more, from a file stream that is run to its end; no record is dropped."""
    return _latest(spark, windowed_ctr(_stream(spark, sf_dir, _records)), "update", ["item_id", "window_start_ms"])


@query(f"WITH {EVT} SELECT item_id, count(*) AS views, CAST(sum(type) AS BIGINT) AS likes, arg_max(event_time_ms, event_id) AS last_event_ms FROM evt GROUP BY 1")
def stream_item_state(spark, sf_dir):
    return _latest(spark, nearline.item_state(_stream(spark, sf_dir, _records)), "update", ["item_id"])


@query(f"WITH {EVT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM evt) SELECT user_id, string_agg(item_id, ',' ORDER BY event_id) AS last_items, arg_max(event_time_ms, event_id) AS last_event_ms FROM n WHERE back <= 8 GROUP BY 1")
def stream_user_state(spark, sf_dir):
    found = _latest(spark, nearline.user_state(_stream(spark, sf_dir, _records)), "update", ["user_id"])
    return found.withColumn("last_items", F.array_join("last_items", ","))


@query(f"WITH {EVT}, w AS (SELECT item_id, type, event_time_ms - event_time_ms % {HOUR // 4} - unnest([0, 1, 2, 3]) * {HOUR // 4} AS window_start_ms FROM evt) SELECT item_id, window_start_ms, count(*) AS views, CAST(sum(type) AS BIGINT) AS likes FROM w GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    return _latest(spark, nearline.sliding_counts(_stream(spark, sf_dir, _records), "1 hour", "15 minutes"), "update", ["item_id", "window_start_ms"])


@query(f"""WITH {JOURNAL}, v AS (SELECT *, min(CASE WHEN kind = 'shown' THEN seq END) OVER (PARTITION BY user_id, item_id) AS s FROM journal), o AS (SELECT *, kind IN ('shown', 'save', 'dismiss', 'watched') AS known, coalesce(kind = 'shown' OR seq > s, false) AS ok FROM v),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id, kind, known AND ok ORDER BY seq) AS m FROM o) SELECT seq, CASE WHEN NOT known THEN 'unknown_kind' WHEN NOT ok THEN 'not_shown' WHEN m = 1 THEN 'accepted' ELSE 'conflict' END AS status FROM a""")
def stream_journal(spark, sf_dir):
    """The journal as a stream, in two halves: conflicts are found across batches."""
    at = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    apply, rows = nearline.journal_applier(at), views.journal(spark, sf_dir)
    middle = rows.agg(F.max("seq")).first()[0] or 0
    for n, half in enumerate((rows.filter(F.col("seq") <= middle // 2), rows.filter(F.col("seq") > middle // 2))):
        apply(half, n)
    return nearline.applied(spark, at).select("seq", "status")


@query(f"WITH {EVT} SELECT item_id, count(*) AS views, CAST(2 AS BIGINT) AS generation FROM evt GROUP BY 1")
def fenced_generation(spark, sf_dir):
    """The second of two published generations, read back."""
    at = f"{shared_folder(spark)}/fenced-{uuid.uuid4().hex}"
    counts = views.events(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("views"))
    nearline.fenced(spark, at, lambda seen: counts.limit(0).withColumn("generation", F.lit(seen + 1).cast("long")))
    nearline.fenced(spark, at, lambda seen: counts.withColumn("generation", F.lit(seen + 1).cast("long")))
    return nearline.read(spark, at)


# --- neighbour graph -----------------------------------------------------------------------------


def _graph(spark, sf_dir):
    return written(graphs.build(_catalog(spark, sf_dir)), "graph")[0]


@query("SELECT count(*) * 10 AS n, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def graph_recall(spark, sf_dir):
    """The graph's lists against the exact ones of all stated queries: is a recall of 0.9 reached?"""
    q = _query_set(spark, sf_dir)
    found = graphs.search(q, _graph(spark, sf_dir), 10).select("query_id", "item_id", F.lit(1).alias("found"))
    met = vectors.top_k(q, _catalog(spark, sf_dir), 10).join(found, ["query_id", "item_id"], "left")
    return met.agg(F.count("*").alias("n"), (F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("reached"))


@query("SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS faults, true AS linked FROM embeddings")
def graph_audit(spark, sf_dir):
    """All rows are nodes, none with a fault, and the ground layer is no bare chain."""
    nodes = _graph(spark, sf_dir)
    s = graphs.stats(nodes).agg(F.sum("nodes").alias("nodes"), F.min("degree").alias("d"))
    return s.select("nodes", F.lit(graphs.faults(nodes, 16).count()).alias("faults"), (F.col("d") >= 2).alias("linked"))


# --- reports -------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT CAST(floor(value * 300) AS BIGINT) AS v FROM events), l AS (SELECT i, 1 << i AS n FROM range(18) t(i))
SELECT CAST(i AS INTEGER) AS place, 'd_us_bucket{le="' || n || '"} ' || (SELECT count(*) FROM v WHERE v <= n) AS line FROM l UNION ALL SELECT 18, 'd_us_bucket{le="+Inf"} ' || count(*) FROM v UNION ALL SELECT 19, 'd_us_count ' || count(*) FROM v UNION ALL SELECT 20, 'd_us_sum ' || sum(v) FROM v""")
def metrics_text(spark, sf_dir):
    return reports.exposition(table(spark, sf_dir, "events"), F.floor(F.col("value") * 300), "d_us")


@query("""WITH r AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT CAST(0 AS BIGINT) AS place, '| event_type | n |' AS line UNION ALL SELECT 1, '|-|-|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY n DESC, event_type), '| ' || event_type || ' | ' || n || ' |' FROM r""")
def report_board(spark, sf_dir):
    return reports.board(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), F.desc("n"), F.col("event_type"))
