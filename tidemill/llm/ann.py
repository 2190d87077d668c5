"""Approximate nearest neighbours by inner product, with robust-pruned directed graphs.

Rows are dealt to shards of bounded size by a hash of their id.  Each shard builds one graph:
equal vectors become one node, one more coordinate turns largest inner product into least
distance, greedy searches over the graph so far propose neighbours of a batch of new nodes,
and relaxed distance pruning keeps edges of diverse direction.  Blocks of queries search every
shard with a beam that goes by the inner product itself; found nodes are scored again in double precision on the original vectors,
and the shards' best are merged for each query.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
DEGREE = 28
BUILD_BEAM = 56
SEARCH_BEAM = 96
ALPHA = 1.2
_WIDTH = 4  # nodes that one step of a beam expands
_BATCH = 512
#: Nodes, each far from those before, where every search of a shard starts.
STARTS = 256
_LONGEST = 16  # nodes of largest norm where each search of a shard starts too
_LEAST_NORM = 1e-24  # squared norm, as a share of the largest, that single precision can build with


def _distances(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each query to its own list of nodes."""
    near = x[rows]
    near -= q[:, None, :]
    return np.einsum("qrd,qrd->qr", near, near)


def _products(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Negative inner product of each query with its own list of nodes."""
    return -np.einsum("qrd,qd->qr", x[rows], q)


def beam_search(x: np.ndarray, graph: np.ndarray, start, queries: np.ndarray, beam: int, measure=_distances) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the ``beam`` best nodes that each query reaches; -1 and infinity pad.

    ``graph`` has a row of neighbours for each node, padded with -1.  ``start`` is a node or
    different ones; the search goes on from the best ``beam`` of them.
    """
    n, count = len(x), len(queries)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # where padding points
    nodes = np.full((count, beam), -1)
    away = np.full((count, beam), np.inf, x.dtype)
    done = np.ones((count, beam), bool)
    first = np.tile(np.atleast_1d(start), (count, 1))
    far = measure(x, first, queries)
    rank, size = np.argsort(far, axis=1, kind="stable")[:, :beam], min(first.shape[1], beam)
    nodes[:, :size], away[:, :size] = np.take_along_axis(first, rank, 1), np.take_along_axis(far, rank, 1)
    done[:, :size], seen[:, start] = False, True
    live = np.arange(count)
    while len(live):
        # the nearest nodes not yet expanded; columns are in order of distance
        rank = np.argsort(done[live], axis=1, kind="stable")[:, :_WIDTH]
        picked = nodes[live[:, None], rank]
        picked = np.where(done[live[:, None], rank], -1, picked)
        done[live[:, None], rank] = True
        new = np.where(picked[:, :, None] >= 0, graph[picked], -1).reshape(len(live), -1)
        new[new < 0] = n
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[live[:, None], new]] = n
        seen[live[:, None], new] = True
        new.sort(axis=1)
        new = new[:, : max(1, int((new < n).sum(1).max()))]
        far = measure(x, np.minimum(new, n - 1), queries[live])
        far[new == n] = np.inf
        both = np.concatenate([away[live], far], axis=1)
        best = np.argsort(both, axis=1, kind="stable")[:, :beam]
        at = np.arange(len(live))[:, None]
        away[live] = both[at, best]
        nodes[live] = np.concatenate([nodes[live], np.where(new == n, -1, new)], axis=1)[at, best]
        flags = np.concatenate([done[live], new == n], axis=1)[at, best]
        done[live] = flags | ~np.isfinite(away[live])
        live = live[~done[live].all(1)]
    return nodes, away


def robust_prune(x: np.ndarray, points: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours for each point out of its row of candidate nodes (-1 pads).

    The nearest candidate stays and drops all candidates that it is ``alpha`` times nearer to
    than the point is, and so on.
    """
    ok = (nodes >= 0) & (nodes != points[:, None])
    near = x[np.where(ok, nodes, 0)]
    away = np.where(ok, ((near - x[points][:, None, :]) ** 2).sum(2), np.inf)
    order = np.argsort(away, axis=1, kind="stable")
    at = np.arange(len(points))[:, None]
    nodes, away, near = nodes[at, order], away[at, order], near[at, order]
    alive = np.isfinite(away)
    alive[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        best = alive.argmax(1)
        has = alive[rows, best]
        if not has.any():
            break
        out[has, k] = nodes[has, best[has]]
        gap = near - near[rows, best][:, None, :]
        gap = np.einsum("pcd,pcd->pc", gap, gap)
        alive &= alpha * alpha * gap > away
        alive[rows, best] = False
    return out


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """The row nearest to the middle, then ``count - 1`` others (fewer if rows are equal), each the farthest from those before."""
    found = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    norm = (x * x).sum(1)
    away = np.full(len(x), np.inf, x.dtype)
    while len(found) < min(count, len(x)):
        last = found[-1]
        np.minimum(away, norm - 2 * (x @ x[last]) + norm[last], out=away)
        away[last] = -np.inf
        far = int(away.argmax())
        if not away[far] > 0:
            break
        found.append(far)
    return np.array(found)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(graph, starts) over the rows of ``x``, inserted in batches that double in size.

    Searches begin at nodes spread over all rows, as edges seldom lead from one tight cluster to another.
    """
    n = len(x)
    graph = np.full((n, degree), -1)
    starts = spread(x, STARTS)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    at = 1
    while at < n:
        new = order[at : at + min(_BATCH, max(1, at))]
        at += len(new)
        found, _ = beam_search(x, graph, starts[: at - len(new)], x[new], beam)
        graph[new] = robust_prune(x, new, found, degree, alpha)
        # edges back; a node with too many is pruned again
        source, target = np.repeat(new, degree), graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        sizes = np.diff(np.append(heads, len(target)))
        nodes = target[heads]
        extra = np.full((len(nodes), int(sizes.max(initial=1))), -1)
        extra[np.repeat(np.arange(len(nodes)), sizes), np.arange(len(target)) - np.repeat(heads, sizes)] = source
        for i in range(0, len(nodes), _BATCH):
            some = nodes[i : i + _BATCH]
            more = extra[i : i + _BATCH]
            graph[some] = robust_prune(x, some, np.concatenate([graph[some], more[:, : int((more >= 0).sum(1).max())]], axis=1), degree, alpha)
    return reachable(graph, int(starts[0])), starts


def reachable(graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with an edge to each node that no path from ``start`` reaches, from one of its own neighbours."""
    n = len(graph)
    seen = np.zeros(n, bool)
    front = np.array([start])
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(graph[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return graph
        for u in lost.tolist():
            near = graph[u][graph[u] >= 0]
            near = near[seen[near]]
            v = int(near[0]) if len(near) else start
            free = np.flatnonzero(graph[v] < 0)
            if not len(free):
                free = [graph.shape[1]]
                graph = np.concatenate([graph, np.full((n, 4), -1)], axis=1)
            graph[v, free[0]] = u
        front = lost


def _power_of_two(x):
    """The power of two that brings positive values between a half and one; dividing by it is exact."""
    return np.ldexp(1.0, np.minimum(np.frexp(x)[1], 1023))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    return vectors / _power_of_two(np.abs(vectors).max())


class Shard:
    """The graph of one shard, with the ids of each distinct vector in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.vectors, at = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, at.ravel()))
        self.ids = ids[order]
        self.heads = np.searchsorted(at.ravel()[order], np.arange(len(self.vectors) + 1))
        scaled = _scaled(self.vectors)
        norm = (scaled**2).sum(1)
        # the further coordinate less its largest value, so that small norms keep their digits
        extra = -norm / (np.sqrt(norm.max()) + np.sqrt(np.maximum(norm.max() - norm, 0)))
        self.kind = np.float32 if norm.min() > _LEAST_NORM * norm.max() else np.float64
        points = np.concatenate([scaled, extra[:, None]], axis=1).astype(self.kind)
        self.graph, starts = build_graph(points)
        self.graph = self.graph.astype(np.int32)
        self.points = np.ascontiguousarray(points[:, :-1])
        # few edges lead to a node that is much longer than the others
        longest = np.argsort(-norm, kind="stable")[:_LONGEST]
        self.start = np.append(starts, longest[~np.isin(longest, starts)])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int):
        """(query_id, vec_id, score) of the best ``k`` found for each query, its own row left out."""
        flat = (queries / _power_of_two(np.abs(queries).max(1))[:, None]).astype(self.kind)
        best = min(k + 1, len(self.vectors))
        for i in range(0, len(queries), _BATCH):
            nodes, _ = beam_search(self.points, self.graph, self.start, flat[i : i + _BATCH], max(beam, best), _products)
            q = np.repeat(np.arange(i, i + len(nodes)), nodes.shape[1])[nodes.ravel() >= 0]
            node = nodes.ravel()[nodes.ravel() >= 0]
            score = np.einsum("nd,nd->n", self.vectors[node], queries[q])
            size = np.minimum(self.heads[node + 1] - self.heads[node], k + 1)
            ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.heads[node] - (np.cumsum(size) - size), size)]
            q, score = np.repeat(q, size), np.repeat(score, size)
            other = ids != query_ids[q]
            q, score, ids = q[other], score[other], ids[other]
            order = np.lexsort((ids, -score, q))
            q, score, ids = q[order], score[order], ids[order]
            first = np.searchsorted(q, np.arange(i, i + len(nodes)))
            keep = np.arange(len(q)) - first[q - i] < k
            yield query_ids[q[keep]], ids[keep], score[keep]


def usable(vector: Column) -> Column:
    """True for vectors with a component other than zero and none that is null or not finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """For each row that ``queries`` selects, up to ``k`` rows with the largest inner product.

    ``queries`` is a condition on ``vectors``.  Gives query_id, rank (from 1), vec_id, score;
    nearest first, ties to the smaller id; a query's own id is no candidate.  Rows whose id or
    vector is null, zero or not finite take no part, and vectors meet only those of the same
    length.  Repeated rows are candidates each; of repeated query ids the shortest, then least vector asks.  Too few
    candidates give fewer rows.
    """
    source = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    asked = source.where(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.size(vector_col).alias("dim"))
    asked = asked.groupBy("id", "dim").agg(F.min("vector").alias("vector")).groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("least")).select("id", "least.*")
    rows = source.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.size(vector_col).alias("dim"))

    def pack(df: DataFrame, most: int, name: str, work) -> DataFrame:
        sizes = {r["dim"]: -(-r["count"] // most) for r in df.groupBy("dim").count().collect()}
        parts = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in sizes.items()), F.lit(1))
        dealt = df.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        dealt = dealt.repartition(max(sum(sizes.values()), 1), "dim", "part")
        made = dealt.groupBy("dim", "part").applyInPandas(lambda key, pdf: pd.DataFrame({"dim": [key[0]], "part": [key[1]], "payload": [work(pdf)]}), "dim int, part int, payload binary")
        return materialize(made, name), sizes

    index, shards = pack(rows, shard_rows, "ann-index", lambda pdf: pickle.dumps(Shard(pdf["id"].to_numpy(), _stacked(pdf["vector"]))))
    blocks, counts = pack(asked, BLOCK_QUERIES, "ann-queries", lambda pdf: pickle.dumps((pdf["id"].to_numpy(), _stacked(pdf["vector"]))))
    number = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in shards.items()), F.lit(1))
    asked_of = F.explode(F.sequence(F.lit(0), number - 1)).alias("part")
    # a merge join, as a broadcast of the blocks, one copy for each shard, would grow with queries times shards
    pairs = blocks.select("dim", asked_of, F.col("payload").alias("asked")).join(index.hint("merge"), ["dim", "part"])
    tasks = sum(n * shards.get(d, 0) for d, n in counts.items())

    def search(batches):
        for pdf in batches:
            for shard, block in zip(pdf["payload"], pdf["asked"]):
                ids, queries = pickle.loads(block)
                for q, v, s in pickle.loads(shard).search(ids, queries, k, beam):
                    yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = pairs.repartition(max(tasks, 1)).mapInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
