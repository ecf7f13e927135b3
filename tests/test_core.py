"""The engine's queries against their SQL on the smallest tables, and small golden cases."""

import os

import duckdb
import pytest

from marlstone import queries as Q

SF = "/root/testdata/sf0.001"


def _rows(columns, data):
    out = []
    for row in data:
        out.append(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in (row[i] for i in sorted(range(len(columns)), key=lambda i: columns[i]))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, want = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got.columns, [tuple(r) for r in got.collect()]), _rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, (int, float)) and abs(float(p) - float(q)) < 1e-5) for p, q in zip(x, y)), (x, y)


def test_empty_and_null_events(spark):
    from marlstone.operators import ctr

    e = spark.createDataFrame([(1, 1000, 7, None, 1), (2, 1000, 7, 3, 0)], "event_id long, event_time_ms long, user_id long, item_id long, type int")
    assert {(r.item_id, r.views, r.likes) for r in ctr.item_ctr(e).collect()} == {(None, 1, 1), (3, 1, 0)}
    assert ctr.item_ctr(e.limit(0)).count() == 0
    assert ctr.sliding_ctr(e.limit(0), 1000, 5).count() == 0


def test_publication_chain_of_regular_events(spark):
    from marlstone.operators import ctr

    e = spark.range(20_000).selectExpr("id as event_id", "1000000 + id as event_time_ms", "0L as user_id", "id % 7 as item_id", "0 as type")
    r = ctr.skew(e, [100]).first()
    assert (r.published, r.unpublished, r.watermark_ms) == (19_901, 99, 1_019_900)


def test_event_record_round_trip(spark):
    from marlstone.sources import event17

    e = spark.createDataFrame([(2**62 + 5, 4294967295, 2147483648, 1), (0, 0, 0, 0)], "event_time_ms long, user_id long, item_id long, type int")
    back = event17.decode(event17.encode(e).select("payload")).drop("payload", "bad")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    assert event17.decode(spark.createDataFrame([(b"short",)], "payload binary")).first().bad


def test_fold_in_prefers_what_was_liked(spark):
    from marlstone.operators import vectors

    cat = spark.createDataFrame([(i, [float(i == d) for d in range(3)]) for i in range(3)], "item_id long, embedding array<float>")
    prefs = spark.createDataFrame([(9, 0, 1), (9, 1, -1), (8, 2, -1)], "query_id long, item_id long, value int")
    found = {r.query_id: r.embedding for r in vectors.als_fold_in(prefs, cat).collect()}
    assert set(found) == {9} and found[9][0] > 0.99


def test_generations_are_whole(spark, tmp_path):
    from marlstone.streaming.ctr_stream import current, publisher

    publish = publisher(str(tmp_path / "snap"))
    publish(spark.range(5), 1)
    publish(spark.range(7), 2)
    publish(spark.range(7), 2)  # again after a failure
    assert current(spark, str(tmp_path / "snap")).count() == 7


def test_matrix_files(spark, tmp_path):
    import struct

    import numpy as np

    from marlstone.sources import matrices

    m = np.arange(6, dtype="<f4").reshape(2, 3)
    good = struct.pack("<Iii", matrices.CATALOG_MAGIC, 2, 3) + m.tobytes()
    (tmp_path / "c.bin").write_bytes(good)
    assert [r.embedding for r in matrices.read(spark, str(tmp_path / "c.bin")).orderBy("item_id").collect()] == m.tolist()
    for bad in (good[:-1], b"x" + good[1:], good[:4] + b"\xff" * 4 + good[8:], good[:-4] + struct.pack("<f", float("nan"))):
        with pytest.raises(ValueError):
            matrices.parse(bad, matrices.CATALOG_MAGIC)


def test_synthetic_inputs(spark):
    from marlstone.sources import synthetic

    r = synthetic.zipf_events(spark, 5000, 10, 50).groupBy("item_id").count().orderBy("item_id").collect()
    assert r[0].item_id == 0 and r[-1].item_id <= 49 and r[0]["count"] > 3 * r[-1]["count"]
    v = synthetic.clustered_catalog(spark, 20, 8).collect()
    assert all(abs(sum(x * x for x in row.embedding) - 1) < 1e-5 for row in v)
    raw = spark.createDataFrame([("1", "", "7", "0.5"), ("2", "3", "8", None), (None, "4", "9", "1")], "user_id string, video_id string, item string, watch_ratio string")
    assert [tuple(x) for x in synthetic.watched(raw).orderBy("user").collect()] == [(1, 7, 0, 0.5), (2, 3, 0, 0.0)]


def test_accounts(spark, tmp_path):
    from marlstone.operators import accounts

    changes = spark.createDataFrame([(1, 5, 1, 1), (1, 5, 0, 2), (1, 6, -1, 3), (2, 5, 1, 4)], "user_id long, item_id long, value int, revision long")
    prefs = accounts.preferences(changes)
    assert {tuple(r) for r in prefs.collect()} == {(1, 6, -1, 3), (2, 5, 1, 4)}
    left = accounts.without_deleted({"p": prefs}, spark.createDataFrame([(1,)], "user_id long"))["p"]
    assert [r.user_id for r in left.collect()] == [2]
    assert accounts.exported({"p": prefs, "c": changes}, 2).count() == 2
    path = str(tmp_path / "bundle")
    accounts.write_bundle({"catalog": spark.range(3), "movies": spark.range(4)}, path)
    assert accounts.faults(spark, path).count() == 0
    next((tmp_path / "bundle" / "movies").glob("*.parquet")).unlink()
    assert accounts.faults(spark, path).first().fault == "missing"


def test_popular_lists_go_on_past_their_first_part(spark):
    from marlstone.operators.evaluation import popular_unseen
    from marlstone.operators.journal import selected

    # item i is had by users 1000 .. 1000 + 30 - i; user 1 has had the first 25, user 2 all of them, user 3 none
    train = [(1000 + u, i) for i in range(30) for u in range(30 - i)] + [(1, i) for i in range(25)] + [(2, i) for i in range(30)] + [(1, 0)]
    t = spark.createDataFrame(train, "user long, item long")
    got = {}
    for r in popular_unseen(spark.createDataFrame([(1,), (2,), (3,), (1,)], "user long"), t, 4, depth=8).orderBy("user", "rank").collect():
        got.setdefault(r.user, []).append((r["rank"], r["item"]))
    assert got == {1: [(1, 25), (2, 26), (3, 27), (4, 28)], 3: [(1, 0), (2, 1), (3, 2), (4, 3)]}
    cand = spark.createDataFrame([(1, 26, 0.5, 1), (2, 3, 0.5, 1), (3, 7, 0.5, 1)], "query_id long, item_id long, score double, rank int")
    blocked = t.withColumnsRenamed({"user": "query_id", "item": "item_id"})
    features = spark.createDataFrame([], "item_id long, shown long, saved long")
    popular = spark.createDataFrame([(i, i + 1) for i in range(30)], "item_id long, pop int")
    got = {}
    for r in selected(cand, blocked, features, popular, 4, 30, depth=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {1: [26, 25, 27, 28], 3: [7, 0, 1, 2]}


def test_a_user_who_has_had_almost_all(spark):
    from marlstone.operators.evaluation import popular_unseen

    t = spark.createDataFrame([(1, i) for i in range(590)] + [(2, i) for i in range(600)], "user long, item long")
    got = popular_unseen(spark.createDataFrame([(1,)], "user long"), t, 10).collect()
    assert sorted(r["item"] for r in got) == list(range(590, 600))


def test_fills_score_below_all_candidates_and_take_part_in_the_order(spark):
    from marlstone.operators.journal import selected

    cand = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.2, 2)], "query_id long, item_id long, score double, rank int")
    blocked = spark.createDataFrame([(1, 8)], "query_id long, item_id long")
    features = spark.createDataFrame([(3, 2, 8)], "item_id long, shown long, saved long")
    popular = spark.createDataFrame([(8, 1), (2, 2), (3, 3), (7, 4)], "item_id long, pop int")
    got = [(r.item_id, r.score, r.candidate_source) for r in selected(cand, blocked, features, popular, 3, 100).orderBy("rank").collect()]
    # least is that of item 8, which is blocked: 0.2; item 3 gains 0.05 * 8 / 4
    assert got == [(7, 0.5, "retrieval"), (3, round(0.2 - 1 - 2 / 100 + 0.1, 6), "popular"), (2, round(0.2 - 1 - 1 / 100, 6), "popular")]


def _applied(rows, issued=None):
    """One row after the other, as a store would take them."""
    taken, out = [], {}
    for r in sorted(rows):
        seq, e, u, i, k, t, q = r
        old = next((x for x in taken if x[1] == e), None)
        if k not in ("shown", "save", "dismiss", "watched"):
            out[seq] = "unknown_kind"
        elif old:
            out[seq] = "duplicate" if old[1:] == r[1:] else "conflict"
        elif issued is not None and (q, i) not in issued:
            out[seq] = "not_issued"
        elif issued is not None and issued[q, i][0] != u:
            out[seq] = "not_issued"
        elif issued is not None and t < issued[q, i][1] - 30_000:
            out[seq] = "too_early"
        elif k != "shown" and not any(x[6] == q and x[3] == i and x[4] == "shown" for x in taken):
            out[seq] = "not_shown"
        elif any((x[6], x[3], x[4]) == (q, i, k) for x in taken):
            out[seq] = "conflict"
        else:
            out[seq] = "accepted"
            taken.append(r)
    return out


def test_journal_is_applied_row_by_row(spark):
    import random

    from marlstone.operators import journal

    rng = random.Random(5)
    rows = [(s, rng.randrange(60), rng.randrange(3), rng.randrange(3), rng.choice(["shown", "shown", "save", "dismiss", "watched", "other"]), 1_000_000 + rng.choice([0, 0, 5, -40_000]), rng.randrange(4)) for s in range(300)]
    cols = "seq long, event_id long, user_id long, item_id long, kind string, event_time_ms long, request_id long"
    events = spark.createDataFrame(rows, cols)
    got = {r.seq: r.status for r in journal.accepted(events).collect()}
    assert got == _applied(rows) and {"accepted", "duplicate", "conflict", "not_shown", "unknown_kind"} <= set(got.values())
    impressions = spark.createDataFrame([(q, q % 3, 1_000_000) for q in range(4)], "request_id long, user_id long, created_ms long")
    shown = journal.exposures(spark.createDataFrame([(q, [0, 1]) for q in range(4)], "request_id long, items array<long>"))
    got = {r.seq: r.status for r in journal.accepted(events, impressions, shown).collect()}
    assert got == _applied(rows, {(q, i): (q % 3, 1_000_000) for q in range(4) for i in (0, 1)}) and {"too_early", "not_issued"} <= set(got.values())
    # what was accepted gives the same projection when it is applied again
    once = journal.accepted(events).filter("status = 'accepted'")
    again = journal.accepted(once.drop("status"))
    assert sorted(map(tuple, journal.projection(once.withColumn("status", once.status)).collect())) == sorted(map(tuple, journal.projection(again).collect()))
    # a rejected row claims nothing
    few = [(1, 1, 0, 0, "shown", 1, 9), (2, 1, 0, 0, "save", 1, 9), (3, 2, 0, 0, "save", 1, 9)]
    assert {r.seq: r.status for r in journal.accepted(spark.createDataFrame(few, cols)).collect()} == {1: "accepted", 2: "conflict", 3: "accepted"}
    old = spark.createDataFrame([(1, 1, 0, 0, "shown", 10**9, 9, 10**9 + 86_400_001), (2, 2, 0, 0, "shown", 10**9, 9, 10**9)], cols + ", received_ms long")
    assert [r.status for r in journal.accepted(old).orderBy("seq").collect()] == ["expired", "accepted"]


def test_requests_under_one_id(spark):
    from marlstone.operators.journal import replayed

    got = replayed(spark.createDataFrame([(1, "a", 7, 10), (2, "a", 7, 10), (3, "a", 7, 11), (4, "b", 7, 10)], "seq long, request_id string, user_id long, k int")).orderBy("seq").collect()
    assert [r.status for r in got] == ["computed", "stored", "conflict", "computed"]


def test_sessions_and_maintenance(spark):
    from marlstone.operators.journal import DAY_MS, maintained, valid_sessions

    now = 100 * DAY_MS
    s = spark.createDataFrame([(1, now - DAY_MS, now - 5), (1, now - 8 * DAY_MS, now - 5), (1, now - DAY_MS, now - 2 * DAY_MS), (2, now - DAY_MS, now - 5), (3, now - DAY_MS, now - 5)], "user_id long, created_ms long, seen_ms long")
    users = spark.createDataFrame([(1, False), (2, True)], "user_id long, disabled boolean")
    assert [tuple(r) for r in valid_sessions(s, users, now).collect()] == [(1, now - DAY_MS, now - 5)]
    out = spark.createDataFrame([(now - 9 * DAY_MS, None), (now - 9 * DAY_MS, 5), (now - 7 * DAY_MS, 5)], "created_ms long, delivered_ms long")
    win = spark.createDataFrame([(now // 60_000 - k,) for k in range(5)], "window long")
    left = maintained({"sessions": s, "outbox": out, "rate_limits": win, "other": users}, now)
    assert left["sessions"].count() == 3 and left["outbox"].count() == 2 and left["rate_limits"].count() == 3 and left["other"].count() == 2


@pytest.mark.parametrize("given, want", [((0.06, 0, 100, 1, 1, 1), "overload"), ((0, 0, 1000, 450, 0, 100), "feature_store_wait"), ((0, 0, 1000, 0, 450, 100), "queueing"), ((0, 0, 1000, 600, 0, 700), "cpu_bound_scoring"), ((0, 0, 1000, 10, 10, 10), "unknown")])
def test_bottlenecks(spark, given, want):
    from pyspark.sql import functions as F

    from marlstone.operators.operations import bottleneck

    assert spark.range(1).select(bottleneck(*(F.lit(float(x)) for x in given)).alias("b")).first().b == want
    if want == "unknown":
        assert spark.range(1).select(bottleneck(*(F.lit(float(x)) for x in given), F.lit(0.5), F.lit(30.0)).alias("b")).first().b == "cache_miss_likely"


def test_unsound_measurements_never_pass(spark):
    from marlstone.operators.operations import regression_verdict

    side = lambda *rows: spark.createDataFrame(rows, "p99 double, recall double, qps double")
    good = side((100.0, 0.99, 5.0), (110.0, 0.99, 5.0), (90.0, 0.99, 5.0))
    assert regression_verdict(good, good).first().passed
    for bad in ((None, 0.99, 5.0), (float("nan"), 0.99, 5.0), (0.0, 0.99, 5.0), (-5.0, 0.99, 5.0), (100.0, 1.5, 5.0), (100.0, 0.99, 0.0), (100.0, 0.99, float("inf"))):
        assert not regression_verdict(good, good.unionByName(side(bad))).first().passed, bad
    assert not regression_verdict(good, good.limit(0)).first().passed
    assert not regression_verdict(good, side((130.0, 0.99, 5.0))).first().passed and not regression_verdict(good, side((100.0, 0.9, 5.0))).first().passed


def test_percentiles_by_counts(spark):
    import numpy as np

    from marlstone.operators.campaigns import percentile_of

    x = np.random.default_rng(2).lognormal(3, 1, 3000).round(2)
    rows = [(i % 3, float(v)) for i, v in enumerate(x)] + [(7, 5.0)] * 10 + [(8, 1.0), (8, None)]
    for q in (0.5, 0.99, 0.0, 1.0):
        got = {r.g: (r.n, r.p) for r in percentile_of(spark.createDataFrame(rows, "g long, v double"), q).collect()}
        for g in (0, 1, 2, 7, 8):
            v = [b for a, b in rows if a == g and b is not None]
            assert got[g][0] == len(v) and abs(got[g][1] - np.quantile(v, q)) < 1e-9


def test_numbered_rows(spark):
    from marlstone.operators.tables import numbered

    rows = numbered(spark.range(1000).selectExpr("id * 37 % 1000 as id").repartition(5), "at", "id").collect()
    assert sorted((r["at"], r["id"]) for r in rows) == [(i + 1, i) for i in range(1000)]
    assert numbered(spark.range(0), "at", "id").count() == 0


def test_traces(spark):
    from marlstone.operators import traces

    calls = spark.createDataFrame([("t", 0, 5, 1, 1), ("t", 6, 8, 2, 2), ("t", 10, 30, 3, 3), ("t", 40, 41, 4, 2), ("u", 1, 2, 5, 1), ("t", 50, 51, 6, 9)], "thread string, start long, end long, correlation long, name_id int")
    names = spark.createDataFrame([(1, "copyAsync_v2"), (2, "launch"), (3, "synchronize")], "id int, value string")
    inside = traces.episodes(traces.named(calls, names), "copyAsync", "synchronize")
    assert sorted((r.thread, r.start, r.begin, r.until) for r in inside.collect()) == [("t", 0, 0, 30), ("t", 6, 0, 30), ("t", 10, 0, 30)]
    kernels = spark.createDataFrame([(7, 9, 2), (25, 33, 2), (1, 2, 4)], "start long, end long, correlation long")
    assert [tuple(r)[2:] for r in traces.device_work(inside, kernels).collect()] == [(2, 10, 1)]
    ranges = spark.createDataFrame([("t", 0, 30, "whole"), ("t", 5, 31, "over"), ("u", 5, 6, "other"), ("t", 35, 36, "after"), ("t", 7, 8, "in")], "thread string, start long, end long, name string")
    assert sorted((r.name, r.offset, r.duration) for r in traces.contained(inside, ranges).collect()) == [("in", 7, 1), ("whole", 0, 30)]


def test_sinks(spark, tmp_path):
    from marlstone.sources import matrices, sinks

    f = spark.createDataFrame([(i, 10 + i, i, i / (10 + i)) for i in range(50)] + [(99, 0, 0, 0.0)], "item_id long, views long, likes long, ctr double").repartition(4)
    sinks.write_features(f, str(tmp_path / "f"))
    lines = next((tmp_path / "f").glob("part*")).read_text().splitlines()
    assert lines[0] == "item,views,likes,ctr" and lines[2] == "1,11,1,0.090909091" and len(lines) == 51
    assert sinks.read_features(spark, str(tmp_path / "f")).agg({"views": "sum"}).first()[0] == sum(10 + i for i in range(50))
    v = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(20)], "item_id long, embedding array<float>").repartition(3)
    sinks.write_matrix(v, str(tmp_path / "m"), matrices.CATALOG_MAGIC)
    back = sinks.read_matrix(spark, str(tmp_path / "m"), matrices.CATALOG_MAGIC).orderBy("part", "row").collect()
    assert [r.embedding for r in back] == [[float(i), 0.5] for i in range(20)]
    with pytest.raises(Exception):
        sinks.read_matrix(spark, str(tmp_path / "m"), 1).collect()
    (tmp_path / "p.csv").write_text("query_row,item\n1,5\n1,4\n1,5\n2,9\nx,y\n")
    assert [tuple(r) for r in sinks.read_pairs(spark, str(tmp_path / "p.csv")).orderBy("query_row").collect()] == [(1, [4, 5]), (2, [9])]
    got = sinks.lag(spark.createDataFrame([(0, 10, 4), (1, 3, 9), (2, None, 1), (3, 4, None)], "partition int, high long, last long")).orderBy("partition").collect()
    assert [r.lag for r in got] == [5, 0, None, 4]
    (tmp_path / "metrics").write_text("# HELP x\na_total 5\nb{le=\"1\"} 7\nbad line here\nc x\n")
    assert {tuple(r) for r in sinks.scraped(spark, str(tmp_path / "metrics")).collect()} == {("a_total", 5), ('b{le="1"}', 7)}
    train = spark.createDataFrame([(5, 70), (3, 80)], "user long, item long")
    sinks.write_training({"factors": v}, train, train.limit(1), str(tmp_path / "t"))
    assert {(r.user, r["row"]) for r in spark.read.parquet(str(tmp_path / "t" / "user_map")).collect()} == {(3, 0), (5, 1)}


def test_bootstrap_does_not_depend_on_partitions(spark):
    from marlstone.operators.evaluation import bootstrap_interval

    d = spark.range(300).selectExpr("id as user", "cast(id % 7 as double) - 3 as difference")
    a, b = (bootstrap_interval(d.repartition(n), "difference", 200).first() for n in (1, 5))
    assert a.n == b.n == 300 and abs(a.low - b.low) < 1e-9 and abs(a.high - b.high) < 1e-9 and a.low < a["mean"] < a.high


def _stream(spark, folder, rows, schema, files):
    """``rows`` as a stream of ``files`` files, one a batch, in order."""
    import time

    per = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * per : (i + 1) * per], schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_nearline_state(spark, tmp_path):
    import random

    from marlstone.streaming import nearline

    rng = random.Random(3)
    rows = [(i, 1000 + 7 * i, rng.randrange(5), rng.randrange(9), rng.randrange(2)) for i in range(120)]
    stream = _stream(spark, tmp_path / "in", rows, "event_id long, event_time_ms long, user_id long, item_id long, type int", 3)
    users, items = {}, {}
    run = nearline.drained(nearline.user_state(stream), lambda b, n: users.update({r.user_id: (r.last_items, r.last_event_ms) for r in b.collect()}), str(tmp_path / "u"), "update")
    nearline.drained(nearline.item_state(stream), lambda b, n: items.update({r.item_id: (r.views, r.likes, r.last_event_ms) for r in b.collect()}), str(tmp_path / "i"), "update")
    for u in range(5):
        mine = [r for r in rows if r[2] == u]
        assert users[u] == ([r[3] for r in mine][-8:], mine[-1][1])
    for i in range(9):
        mine = [r for r in rows if r[3] == i]
        assert items[i] == (len(mine), sum(r[4] for r in mine), mine[-1][1])
    seen = nearline.progress(run.recentProgress)
    assert seen[-1]["consumed"] == 120 and {s["lag"] for s in seen} == {None}


def test_lag_of_numbered_offsets():
    from marlstone.streaming.nearline import progress

    report = {"batchId": 4, "eventTime": {"watermark": "w"}, "sources": [{"description": "k", "numInputRows": 7, "latestOffset": {"t": {"0": 10, "1": 3}}, "endOffset": {"t": {"0": 4, "1": 5}}}]}
    assert progress([report]) == [{"batch": 4, "source": "k", "rows": 7, "consumed": 7, "lag": 6, "watermark": "w"}]


def test_sliding_counts(spark, tmp_path):
    from datetime import datetime

    from marlstone.streaming import nearline

    rows = [(datetime(2020, 1, 1, 0, 0, 3), 1, 1), (datetime(2020, 1, 1, 0, 0, 4), 1, 0)]
    got = nearline.sliding_counts(spark.createDataFrame(rows, "ts timestamp, item_id long, type int"), "3 seconds", "1 second")
    start = min(r.window_start_ms for r in got.collect())
    assert sorted((r.window_start_ms - start, r.views, r.likes) for r in got.collect()) == [(0, 1, 1), (1000, 2, 1), (2000, 2, 1), (3000, 1, 0)]


def test_journal_in_batches_equals_one_pass(spark, tmp_path):
    import random

    from marlstone.operators import journal
    from marlstone.streaming import nearline

    rng = random.Random(8)
    rows = [(s, rng.randrange(40), rng.randrange(3), rng.randrange(4), rng.choice(["shown", "shown", "save", "dismiss", "other"]), rng.choice([1, 1, 2])) for s in range(150)]
    schema = "seq long, event_id long, user_id long, item_id long, kind string, event_time_ms long"
    path = str(tmp_path / "out")
    apply = nearline.journal_applier(path)
    nearline.drained(_stream(spark, tmp_path / "in", rows, schema, 3), apply, str(tmp_path / "c"))
    apply(spark.createDataFrame(rows[100:], schema), 2)  # once more, after a failure
    want = {r.seq: r.status for r in journal.accepted(spark.createDataFrame(rows, schema)).collect()}
    assert {r.seq: r.status for r in nearline.applied(spark, path).collect()} == want and len(set(want.values())) >= 4


def test_publication_is_fenced(spark, tmp_path):
    from marlstone.streaming import nearline

    path = str(tmp_path / "g")
    assert nearline.generation(spark, path) == 0 and nearline.publish(spark.range(3), path, 0)
    assert not nearline.publish(spark.range(4), path, 0) and nearline.read(spark, path).count() == 3
    tries = []

    def compute(seen):
        tries.append(seen)
        if len(tries) < 3:
            assert nearline.publish(spark.range(seen), path, seen)  # another writer comes first
        return spark.range(10 + seen)

    assert nearline.fenced(spark, path, compute) == 4 and tries == [1, 2, 3] and nearline.read(spark, path).count() == 13
    with pytest.raises(nearline.Changed):
        nearline.fenced(spark, path, lambda seen: nearline.publish(spark.range(1), path, seen) and spark.range(2))


def test_policy_rules_on_odd_rows(spark):
    from pyspark.sql import functions as F

    from marlstone.functions import rules
    from marlstone.operators import policy

    ids = ["a", "", None, "x" * 128, "x" * 129, "a b", "tab\t", "ü€", "line\n"]
    got = [r.ok for r in spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, v string").orderBy("i").select(rules.is_identifier(F.col("v")).alias("ok")).collect()]
    assert got == [True, False, False, True, False, False, False, True, False]
    bounds = [(0, 5, 5), (1, 5, 5), (20, 5, 5), (21, 5, 5), (None, 5, 5), (5, 0, 5), (5, 65537, 5), (5, 5, 0), (5, 5, None)]
    got = [r.f for r in spark.createDataFrame(bounds, "k int, r int, t int").select(rules.request_fault(F.col("k"), F.col("r"), F.col("t"), "account").alias("f")).collect()]
    assert got == ["bad_k", None, None, "bad_k", "bad_k", "bad_retrieve", "bad_retrieve", "bad_timeout", "bad_timeout"]
    left, right = spark.createDataFrame([(1,), (1,), (2,), (None,)], "i int"), spark.createDataFrame([(1,), (3,), (None,)], "i int")
    assert sorted(map(tuple, policy.not_shared(left, right, "i").collect())) == [(1, 1, 0), (2, 1, 0), (3, 0, 1)]
    titles = spark.createDataFrame([("Heat (1995)", ["A", "B", "C"]), ("Up (2009) x", [rules.NO_GENRES]), (None, None)], "t string, g array<string>")
    assert [tuple(r) for r in titles.select(rules.plain_title(F.col("t")), rules.genre_label(F.col("g"))).collect()] == [("Heat", "A / B"), ("Up (2009) x", ""), (None, None)]


def test_selected_items(spark):
    from marlstone.operators import policy

    asked = spark.createDataFrame([(1, "ready"), (2, "cold"), (3, "failed"), (4, "ready")], "query_id long, state string")
    cand = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 11, 3), (1, 12, 4), (3, 10, 1)], "query_id long, item_id long, rank int")
    gone = spark.createDataFrame([(1, 11), (2, 14), (4, 10), (4, 12), (4, 14), (4, 15)], "query_id long, item_id long")
    catalog = spark.createDataFrame([(10, True), (11, True), (12, True), (13, False), (14, True), (15, True)], "item_id long, available boolean")
    popular = spark.createDataFrame([(13, 1), (14, 2), (10, 3), (15, 4), (99, 5)], "item_id long, pop int")
    for depth in (1, 512):
        rows = policy.select_items(asked, cand, gone, catalog, popular, 3, "als", depth=depth).orderBy("query_id", "rank").collect()
        lists = {q: [(r.item_id, r.source) for r in rows if r.query_id == q] for q in (1, 2, 3, 4)}
        assert lists == {1: [(10, "als"), (12, "als"), (14, "popularity")], 2: [(10, "popularity"), (15, "popularity")], 3: [(14, "popularity"), (10, "popularity"), (15, "popularity")], 4: [(None, None)]}
        assert {(r.query_id, r.candidate_source, r.degraded, r.exhausted) for r in rows} == {(1, "als", False, False), (2, "popularity", False, True), (3, "popularity", True, False), (4, "als", False, True)}
    with pytest.raises(Exception, match="unknown item 77"):
        policy.select_items(asked, cand.unionByName(spark.createDataFrame([(1, 77, 5)], cand.schema)), gone, catalog, popular, 3, "als").collect()
    assert policy.select_items(asked.limit(0), cand, gone, catalog, popular, 3, "als").count() == 0


def test_neighbour_graph(spark, tmp_path):
    import struct

    import numpy as np

    from marlstone.operators import graphs
    from marlstone.sources import graph_files

    rng = np.random.default_rng(4)
    v = rng.normal(size=(20, 16))[rng.integers(0, 20, 900)] + 0.4 * rng.normal(size=(900, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [])]
    cat = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    nodes = graphs.build(cat, m=8, ef=64, per_shard=400).cache()
    assert nodes.count() == 900 and nodes.select("shard").distinct().count() == 3
    assert graphs.faults(nodes, 8).count() == 0 and all(r.degree > 4 for r in graphs.stats(nodes).collect())
    got = {}
    for r in graphs.search(cat.filter("item_id < 60").withColumnRenamed("item_id", "query_id"), nodes, 10).collect():
        got.setdefault(r.query_id, set()).add(r.item_id)
    want = {i: set(np.argsort(-(v @ v[i]), kind="stable")[:10].tolist()) for i in range(60)}
    assert np.mean([len(got[i] & want[i]) / 10 for i in want]) > 0.95
    one = [r for r in nodes.orderBy("node").collect() if r.shard == 0]
    entry = next(r.node for r in one if r.is_entry)
    good = graph_files.pack([r.layers for r in one], 16, 8, entry)
    (tmp_path / "g.bin").write_bytes(good)
    back = graph_files.read(spark, str(tmp_path / "g.bin")).orderBy("node").collect()
    assert [r.layers for r in back] == [r.layers for r in one]
    put = lambda at, x: good[: 4 * at] + struct.pack("<i", x) + good[4 * at + 4 :]
    n = len(one)
    for bad in (good[:-4], good + b"\0\0\0\0", good[:-1], put(0, 1), put(1, n + 1), put(7, n), put(8, 99), put(8 + n, n), put(8 + n + 16 * n, 65)):
        with pytest.raises(ValueError):
            graph_files.parse(bad)
    cut = nodes.filter("node <> 3")
    assert {r.fault for r in graphs.faults(cut, 8).collect()} == {"dangling"} and {r.fault for r in graphs.faults(nodes, 2).collect()} == {"degree"}
    nodes.unpersist()
    assert graphs.build(cat.limit(0)).count() == 0


def test_configuration_search(spark):
    from marlstone.operators import tuning

    calls = []

    def measure(c):
        calls.append(dict(c))
        p99 = 10.0 * c["ef"] + (300.0 if c["kernel"] == "scalar" else 100.0)
        return {"p99": p99, "retrieve": 10.0 * c["ef"], "score": 10.0, "feature": 1.0, "cv": 0.01, "recall": 0.80 + c["ef"] / 400, "rss": 100.0}

    config, history = tuning.search(spark, measure, floor=0.88, memory=200.0, sigma=5.0, steps=6)
    assert config == {**tuning.START, "ef": 32}
    rows = history.collect()
    assert [(r.knob, r.value, r.verdict) for r in rows[:3]] == [("ef", "48", "accepted"), ("ef", "32", "accepted"), ("kernel", "scalar", "noise")]
    assert rows[-1].step == 0 and rows[-1].verdict == "accepted" and calls.count(dict(tuning.START)) >= 3
    assert tuning.search(spark, measure, floor=0.88, memory=50.0, sigma=5.0, steps=2)[1].orderBy("step").first().verdict == "same"
    grid = tuning.search(spark, measure, floor=0.0, memory=200.0, sigma=5.0, plan="grid", space={"ef": [16, 64]}, steps=9)
    assert grid[0]["ef"] == 16 and grid[1].count() == 3  # the second value is tried once and does not return
    a, b = (tuning.search(spark, measure, floor=0.0, memory=200.0, sigma=5.0, plan="random", steps=3, seed=4)[1].collect() for _ in range(2))
    assert a == b


def test_reports(spark, tmp_path):
    from pyspark.sql import functions as F

    from marlstone.sources import reports, sinks

    v = spark.createDataFrame([(1,), (3,), (200_000,), (None,)], "v long")
    reports.write_lines(reports.exposition(v, F.col("v"), "x_us"), str(tmp_path / "m"))
    got = dict(map(tuple, sinks.scraped(spark, str(tmp_path / "m")).collect()))
    assert got['x_us_bucket{le="2"}'] == 1 and got['x_us_bucket{le="131072"}'] == 2 and got['x_us_bucket{le="+Inf"}'] == 3 and got["x_us_sum"] == 200_004
    t = spark.createDataFrame([("b|c", 1.5), ("a", None)], "name string, `v 1` double")
    reports.write_lines(reports.board(t, "name"), str(tmp_path / "b"))
    text = next((tmp_path / "b").glob("part*")).read_text().splitlines()
    assert text == ["| name | v 1 |", "|-|-|", "| a |  |", "| b\\|c | 1.5 |"]
    assert reports.board(t.limit(0), "name").count() == 2 and reports.exposition(v.limit(0), F.col("v"), "x").count() == 21


def test_exact_search_on_odd_vectors(spark):
    from marlstone.operators import vectors

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, []), (None, [9.0, 9.0]), (2, [0.5, 0.5])]
    cat = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [2.0]), (12, None), (13, [nan, 0.0])], "query_id long, embedding array<float>")
    for int8 in (False, True):
        got = sorted((r.query_id, r["rank"], r.item_id) for r in vectors.top_k(asked, cat, 5, int8=int8).collect())
        assert got == [(10, 1, 1), (10, 2, 2), (10, 3, 2), (11, 1, 7)]
    assert vectors.top_k(asked.limit(0), cat, 5).count() == 0 and vectors.top_k(asked, cat.limit(0), 5).count() == 0
