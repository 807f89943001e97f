"""Approximate nearest neighbours: a robust-pruned directed graph per shard, queried by beam search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.llm.shared import materialize

DEGREE, BEAM, ALPHA = 32, 96, 1.2
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
_WIDE, _CHUNK = 4, 256


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` (q, d) to its own candidates ``b`` (q, c, d)."""
    return np.maximum(0, (b * b).sum(2) - 2 * np.matmul(b, a[:, :, None])[:, :, 0] + (a * a).sum(1)[:, None])


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of many queries in step: every round expands the nearest nodes of each beam not expanded yet.

    Returns nodes and squared distances (queries, beam), nearest first; -1 and infinity where the graph had fewer.
    """
    n, total = len(x), len(queries)
    ids, far = np.full((total, beam), -1, np.int64), np.full((total, beam), np.inf, np.float32)
    for a in range(0, total, _CHUNK):
        q = queries[a:a + _CHUNK]
        rows = np.arange(len(q))
        node = np.full((len(q), beam), -1, np.int64)
        dist = np.full((len(q), beam), np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        node[:, 0], dist[:, 0], done[:, 0] = start, _square(q, np.broadcast_to(x[start], (len(q), 1, x.shape[1])))[:, 0], False
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, start] = seen[:, n] = True
        while True:
            turn = (~done).cumsum(1)
            pick = ~done & (turn <= _WIDE)
            active = pick.any(1)
            if not active.any():
                break
            r = rows[active]
            p = pick[r]
            done[r] |= p
            order = np.argsort(~p, axis=1, kind="stable")[:, :_WIDE]
            nodes = np.where(np.take_along_axis(p, order, 1), np.take_along_axis(node[r], order, 1), -1)
            near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(len(r), -1)
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            near = np.where(seen[r[:, None], near], n, near)
            seen[r[:, None], near] = True
            d = _square(q[r], x[np.minimum(near, n - 1)]).astype(np.float32)
            d[near == n] = np.inf
            all_d = np.concatenate([dist[r], d], 1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(all_d, top, 1), axis=1, kind="stable"), 1)
            dist[r] = np.take_along_axis(all_d, top, 1)
            node[r] = np.take_along_axis(np.concatenate([node[r], np.where(near == n, -1, near)], 1), top, 1)
            done[r] = np.take_along_axis(np.concatenate([done[r], near == n], 1), top, 1)
        ids[a:a + _CHUNK], far[a:a + _CHUNK] = node, dist
    return ids, far


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each point: take the nearest candidate left, drop those it is ``alpha`` times nearer to."""
    out = np.full((len(points), degree), -1, np.int64)
    for a in range(0, len(points), 128):
        p, c = points[a:a + 128], np.sort(candidates[a:a + 128], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c = np.where(c == p[:, None], -1, c)
        v = x[np.maximum(c, 0)]
        own = _square(x[p], v)
        own[c < 0] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        c, own, v = np.take_along_axis(c, order, 1), np.take_along_axis(own, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        norm = (v * v).sum(2)
        cross = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = c >= 0
        rows = np.arange(len(p))
        for k in range(degree):
            if not alive.any():
                break
            i = alive.argmax(1)
            ok = alive[rows, i]
            out[a:a + 128, k] = np.where(ok, c[rows, i], -1)
            alive &= ~((alpha * alpha * cross[rows, i] <= own) & ok[:, None])
            alive[rows, i] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Directed graph (n, degree; -1 pads) and its entry, the point nearest the mean.

    Points are inserted in batches that at most double the graph: a search proposes neighbours, pruning keeps diverse
    ones, and each kept neighbour gets the edge back, pruned anew where it has too many.
    """
    n = len(x)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        batch = order[at:at + min(max(at, 32), 1024)]
        found, _ = beam_search(x, graph, start, x[batch], beam)
        if at < 512:  # early batches also see one another
            found = np.concatenate([found, np.broadcast_to(batch[:degree], (len(batch), len(batch[:degree])))], 1)
        graph[batch] = robust_prune(x, batch, found, degree, alpha)
        source, target = np.repeat(batch, degree), graph[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        slots = np.arange(len(target)) - np.repeat(first, count)
        back = np.full((len(heads), int(count.max(initial=0))), -1, np.int64)
        back[np.repeat(np.arange(len(heads)), count), slots] = source
        wide = np.concatenate([graph[heads], back], 1)
        full = np.array([len(np.unique(w[w >= 0])) > degree for w in wide], bool)
        for i in np.flatnonzero(~full):
            w = np.unique(wide[i][wide[i] >= 0])
            w = w[w != heads[i]]
            graph[heads[i], :len(w)] = w
        if full.any():
            graph[heads[full]] = robust_prune(x, heads[full], wide[full], degree, alpha)
        at += len(batch)
    return graph, start


def _valid(vectors: DataFrame, column: str) -> DataFrame:
    """Rows that take part: an id and a vector of finite, non-null components that are not all zero."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return rows.filter(fine & F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, column: str = "embedding", every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS,
            beam: int = BEAM) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Null, zero and non-finite vectors and null ids take no part; vectors are only compared within their dimension. Rows
    with the query's id are its own; other rows that repeat id and vector are listed once. Ties go to smaller ids, which
    is why of equal vectors only the k + 1 smallest ids can be found, and only those are kept: a vector shared by a
    third of all rows is one node. Inner products become distances by one more coordinate, sqrt(largest norm² - norm²).

    Different vectors are hashed to shards of about ``shard_rows``; a task builds the graph of a shard, which is
    written. Queries go in blocks to every shard, each pair of block and shard being a task's unit, and only the local
    top k come back. Scores are products of the original vectors in double precision.
    """
    rows = _valid(vectors, column)
    ranked = rows.select("vec_id", "v").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    nodes = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))
    nodes = materialize(nodes, "ann-nodes")
    stats = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("norm")).first()
    shards, norm = max(1, -(-stats["n"] // shard_rows)), stats["norm"] or 0.0

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0, norm - (v * v).sum(1)))]).astype(np.float32)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        v = np.array(group["v"].tolist(), np.float64)
        graph, start = build_graph(lifted(v), beam=beam)
        return pd.DataFrame({
            "dim": [v.shape[1]], "shard": [int(group["shard"].iloc[0])], "start": [start], "vectors": [v.tobytes()],
            "graph": [graph.astype("<i4").tobytes()], "ids": [group["ids"].tolist()]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    graphs = dealt.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, start int, vectors binary, graph binary, ids array<array<long>>")
    graphs = materialize(graphs, "ann-graphs")

    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v", F.size("v").alias("dim")).dropDuplicates(["vec_id"])
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(shard) or not len(block):
            return empty
        s = shard.iloc[0]
        v = np.frombuffer(s["vectors"], np.float64).reshape(-1, int(s["dim"]))
        graph = np.frombuffer(s["graph"], "<i4").reshape(len(v), -1).astype(np.int64)
        q = np.array(block["v"].tolist(), np.float64)
        x = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        found, _ = beam_search(lifted(v), graph, int(s["start"]), x, max(beam, k + 1))
        out = []
        for query, own, near in zip(block["vec_id"].tolist(), q, found, strict=True):
            near = near[near >= 0]
            score = (v[near] * own).sum(axis=1)
            hits = sorted((-d, i) for d, node in zip(score.tolist(), near.tolist(), strict=True) for i in s["ids"][node] if i != query)[:k]
            out += [(query, i, -d) for d, i in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    hits = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
