"""Exact search for the largest integer inner products over impact-ordered postings.

Vectors become integers, floor(256 x).  Each shard holds, for every dimension, its rows in order
of their value, cut into segments of one quantised value.  A query turns the segments into
impacts (the most that a row of the segment gains or loses by the dimension) and processes them,
all dimensions together, by descending impact into accumulators.  A row's accumulator plus the
largest impact left in each dimension that hasn't reached it is an upper bound of its score.  Processing stops once
that proves all rows out but a few: they are below the k-th best exact score seen so far, of
this shard or of those before.  The rows that are possible still are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import shards
from tidemill.llm.common import ragged

#: Values of one dimension's quantised impacts at most.
LEVELS = 32
#: Shares of the postings after which a query looks whether it can stop.
STOPS = (1 / 16, 1 / 4, 3 / 8, 1 / 2, 3 / 4)
#: Possible rows, as a share of a shard, that are few enough to be scored.
FEW = 1 / 8


class ImpactIndex:
    """The postings of one shard."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        n, dims = values.shape
        self.values = values.astype(np.int32) if np.abs(values).max(initial=0) < 2**31 else values
        by_value = np.argsort(values, axis=0, kind="stable").T
        self.rows = np.ascontiguousarray(by_value).ravel()
        ordered = np.take_along_axis(values.T, by_value, 1)
        low, high = values.min(initial=0), values.max(initial=0)
        level = np.floor((ordered - low) / max(1.0, np.ceil((high - low + 1) / LEVELS)))
        fresh = np.ones((dims, n), bool)
        fresh[:, 1:] = level[:, 1:] != level[:, :-1]
        self.heads = np.flatnonzero(fresh.ravel())
        self.sizes = np.diff(np.append(self.heads, n * dims))
        self.dims = self.heads // max(n, 1)
        flat = ordered.ravel()
        self.low, self.high = flat[self.heads], flat[self.heads + self.sizes - 1]
        self.largest = np.abs(values).max(axis=0, initial=0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": self.rows.astype(np.uint16 if len(self.ids) <= 1 << 16 else np.uint32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, rows=state["rows"].astype(np.intp))

    def search(self, query_id: int, query: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of rows other than the query's own: all that are among the best ``k`` and at least ``least``, and maybe others."""
        n = len(self.ids)
        factor = query[self.dims]
        most = np.maximum(factor * self.low, factor * self.high)
        impact = np.maximum(np.abs(factor * self.low), np.abs(factor * self.high))
        order = np.argsort(-impact, kind="stable")
        impact, most, dims, heads, sizes = impact[order], most[order], self.dims[order], self.heads[order], self.sizes[order]
        done = np.cumsum(sizes)
        ends = [int(np.searchsorted(done, s * n * len(query))) for s in STOPS] + [len(order)]
        whole = float(np.abs(query) @ self.largest)
        slack = 0.0 if whole < shards.EXACT else 1e-9 * whole  # for rounding
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        gained, seen = np.zeros(n), np.zeros(n)
        gained[own] = -np.inf
        at, possible = 0, np.flatnonzero(gained == 0)
        for end in ends:
            if end > at:
                some = slice(at, end)
                rows = self.rows[ragged(heads[some], sizes[some])]
                gained += np.bincount(rows, np.repeat(most[some], sizes[some]), n)
                seen += np.bincount(rows, minlength=n)
                at = end
            # a dimension that has begun gives a row that it hasn't reached the next impact at most, another one its largest
            begun = np.zeros(len(query), bool)
            begun[dims[:end]] = True
            left = np.zeros(len(query))
            left[dims[end:][::-1]] = impact[end:][::-1]
            further = float(impact[end]) if end < len(order) else 0.0
            bounds = gained + further * (int(begun.sum()) - seen) + float(left[~begun].sum()) + slack
            best = possible if len(possible) <= 4 * k else possible[np.argpartition(-bounds[possible], 4 * k)[: 4 * k]]
            if len(best) >= k:
                least = max(least, float(np.sort(shards.exact_products(self.values[best], query))[-k]))
            possible = possible[bounds[possible] >= least]
            if len(possible) <= max(4 * k, n * FEW):
                break
        return self.ids[possible], shards.exact_products(self.values[possible], query)


def exact_top(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = shards.SHARD_ROWS) -> DataFrame:
    """For each row that ``queries`` selects, the ``k`` rows with the largest inner product of their integers floor(256 x).

    Gives query_id, rank (from 1), vec_id, score (long); ties go to the smaller id, and a
    query's own id is no candidate.  Rows whose id or vector is null, or whose vector holds null
    or a component that isn't finite, take no part; zero vectors do.  Vectors meet only those of the same length.  Repeated rows are
    candidates each; of repeated query ids the least vector asks.  Too few candidates give fewer
    rows, no rows an empty table.  Scores beyond a long count as its limits.
    """
    vector = F.col(vector_col).cast("array<double>")
    source = vectors.where(shards.finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = source.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), F.size(vector_col).alias("dim"))
    asked = source.where(queries).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector).alias("vector")).withColumn("dim", F.size("vector"))
    index, parts = shards.deal(rows, shard_rows, "impact-index", lambda pdf: ImpactIndex(pdf["id"].to_numpy(), shards.floored(pdf["vector"])))
    blocks, counts = shards.deal(asked, shards.BLOCK_QUERIES, "impact-queries", lambda pdf: (pdf["id"].to_numpy(), shards.floored(pdf["vector"])))

    def search(shard, block, held):
        ids, values = block
        if shard is None:
            found = [(int(ids[q]), i, -s) for q, best in held.items() for s, i in best]
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        least = shards.kth(held, len(ids), k)
        for q in range(len(ids)):
            found, scores = shard.search(int(ids[q]), values[q], k, least[q])
            best = np.lexsort((found, -scores))[:k]
            shards.merged(held, [(q, int(scores[i]), int(found[i])) for i in best], k)

    found = shards.meet(index, parts, blocks, counts, search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
