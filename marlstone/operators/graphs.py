"""Approximate search by layered neighbour graphs: a catalog is dealt over shards, each shard holds a graph of its own, and queries visit all.

A shard has a stated size, so building and searching take bounded memory however long the catalog is; more rows make more shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.vectors import valid

TOP_LEVEL = 16


def drawn_level(id_col, m: int, seed: int):
    """A node's level: geometric by the hash of its id, so it does not depend on order or partitions."""
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    return F.least(F.floor(-F.log(u) / F.lit(float(np.log(m)))), F.lit(TOP_LEVEL)).cast("int")


def _closest(vecs, links, q, starts, ef: int, layer: int) -> list[tuple[float, int]]:
    """Best-first search of one layer: up to ``ef`` ``(score, node)``, best first."""
    seen = set(starts)
    found = sorted(zip((vecs[starts] @ q).tolist(), starts, strict=True))
    best = found[-ef:]
    heapq.heapify(best)
    open_ = [(-s, i) for s, i in found]
    heapq.heapify(open_)
    while open_:
        s, i = heapq.heappop(open_)
        if len(best) >= ef and -s < best[0][0]:
            break
        fresh = [j for j in links[i][layer] if j not in seen]
        seen.update(fresh)
        for t, j in zip((vecs[fresh] @ q).tolist(), fresh, strict=True):
            if len(best) < ef or t > best[0][0]:
                heapq.heappush(open_, (-t, j))
                heapq.heappush(best, (t, j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted(best, reverse=True)


def _spread(vecs, ranked: list[tuple[float, int]], most: int) -> list[int]:
    """Of nodes by score, those closer to the query than to any chosen one; then the best of the others, up to ``most``."""
    chosen, others = [], []
    for s, i in ranked:
        if len(chosen) == most:
            break
        (chosen if not chosen or (vecs[chosen] @ vecs[i]).max() < s else others).append(i)
    return chosen + others[: most - len(chosen)]


def _descend(vecs, links, q, entry: int, top: int, bottom: int) -> int:
    for layer in range(top, bottom, -1):
        entry = _closest(vecs, links, q, [entry], 1, layer)[0][1]
    return entry


def graph(vecs: np.ndarray, levels: list[int], m: int, ef: int) -> tuple[list[list[list[int]]], int]:
    """``links[node][layer]`` of the rows, inserted one after another, and the entry node."""
    links: list[list[list[int]]] = []
    entry = 0
    for i, level in enumerate(levels):
        links.append([[] for _ in range(level + 1)])
        if i == 0:
            continue
        q, top = vecs[i], levels[entry]
        starts = [_descend(vecs, links, q, entry, top, min(level, top))]
        for layer in range(min(level, top), -1, -1):
            ranked = _closest(vecs, links, q, starts, ef, layer)
            links[i][layer] = _spread(vecs, ranked, m)
            most = m if layer else 2 * m
            for j in links[i][layer]:
                back = links[j][layer]
                back.append(i)
                if len(back) > most:
                    links[j][layer] = _spread(vecs, sorted(zip((vecs[back] @ vecs[j]).tolist(), back, strict=True), reverse=True), most)
            starts = [n for _, n in ranked]
        if level > top:
            entry = i
    return links, entry


def build(catalog: DataFrame, m: int = 16, ef: int = 100, per_shard: int = 4096, seed: int = 1) -> DataFrame:
    """``(shard, node, item_id, level, is_entry, layers, embedding)`` of ``catalog(item_id, embedding)``; rows without a sound vector are left out.

    Sound is: no null, no entry that is not finite.  Rows go to shards by the hash of their id, about ``per_shard`` in each; a repeated id stays
    repeated.  Vectors of different lengths in one shard are an error.
    """
    rows = catalog.filter(valid(F.col("embedding"))).select("item_id", F.col("embedding").cast("array<float>").alias("embedding"))
    shards = max(1, -(-rows.count() // per_shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")).withColumn("level", drawn_level(F.col("item_id"), m, seed))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", kind="stable").reset_index(drop=True)
        layers, entry = graph(np.stack(rows.embedding.to_numpy()), rows.level.tolist(), m, ef)
        at = range(len(rows))
        return pd.DataFrame({"shard": rows.shard, "node": at, "item_id": rows.item_id, "level": rows.level, "is_entry": [i == entry for i in at], "layers": layers, "embedding": rows.embedding})

    return dealt.groupBy("shard").applyInPandas(run, "shard int, node int, item_id long, level int, is_entry boolean, layers array<array<int>>, embedding array<float>")


def search(queries: DataFrame, nodes: DataFrame, k: int, ef: int = 128) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the best of what each shard's graph finds.  Meant for a query set: each query goes to every shard.

    ``nodes`` should be a written table, as it is read twice: once for the number of shards.
    """

    def run(graph_rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph_rows) and len(asked):
            g = graph_rows.sort_values("node")
            vecs, links, ids = np.stack(g.embedding.to_numpy()), [[list(y) for y in x] for x in g.layers], g.item_id.tolist()
            entry = int(np.flatnonzero(g.is_entry.to_numpy())[0])
            for qid, q in zip(asked.query_id.tolist(), asked.q, strict=True):
                q = np.asarray(q, "float32")
                start = _descend(vecs, links, q, entry, len(links[entry]) - 1, 0)
                out += [(qid, ids[i], round(float(np.dot(vecs[i].astype("f8"), q.astype("f8"))), 6)) for _, i in _closest(vecs, links, q, [start], max(ef, k), 0)[:k]]
        return pd.DataFrame(out, columns=["query_id", "item_id", "score"])

    last = nodes.agg(F.max("shard")).first()[0]
    sent = queries.select("query_id", F.col("embedding").cast("array<float>").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(last or 0))).alias("to"))
    found = nodes.groupBy("shard").cogroup(sent.groupBy("to")).applyInPandas(run, "query_id long, item_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def edges(nodes: DataFrame, by: str = "shard") -> DataFrame:
    """``(by, node, level, layer, place, target)`` of the links."""
    return nodes.select(by, "node", "level", F.posexplode("layers").alias("layer", "ids")).select(by, "node", "level", "layer", F.posexplode("ids").alias("place", "target"))


def faults(nodes: DataFrame, m: int, by: str = "shard") -> DataFrame:
    """``(by, node, layer, target, fault)`` of nodes whose layers or degrees, and of links whose targets are not as they must be; empty for a sound graph."""
    shape = F.when(F.size("layers") != F.col("level") + 1, "levels").when(F.size(F.get("layers", F.lit(0))) > 2 * m, "degree").when(F.exists(F.slice("layers", 2, TOP_LEVEL + 1), lambda x: F.size(x) > m), "degree")
    bad = nodes.select(by, "node", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("int").alias("target"), shape.alias("fault"))
    held = nodes.select(by, F.col("node").alias("target"), F.col("level").alias("_at"))
    met = edges(nodes, by).join(held, [by, "target"], "left")
    why = F.when(F.col("_at").isNull(), "dangling").when(F.col("_at") < F.col("layer"), "layer").when(F.col("target") == F.col("node"), "self")
    return bad.unionByName(met.select(by, "node", "layer", "target", why.alias("fault"))).filter("fault is not null")


def stats(nodes: DataFrame, by: str = "shard") -> DataFrame:
    """``(by, nodes, degree, links, top)``: mean links on the ground layer, links of all layers, the top level."""
    every = F.aggregate("layers", F.lit(0), lambda a, x: a + F.size(x))
    return nodes.groupBy(by).agg(F.count("*").alias("nodes"), F.avg(F.size(F.get("layers", F.lit(0)))).alias("degree"), F.sum(every).alias("links"), F.max("level").alias("top"))
