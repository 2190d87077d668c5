"""Hard negatives for contrastive training: rows of another label, nearly as close to an anchor as its positives.

Each shard of vectors clusters its rows by k-means and keeps them as inverted lists, one for each
cluster, with the centroid and the radius around it.  By Cauchy-Schwarz no row of a cluster
scores over ``q . centroid + |q| radius`` for a query q, nor under ``q . centroid - |q| radius``.
A search visits the clusters by descending upper bound, skips those that lie outside its window
of scores, and stops when the bound falls strictly below its k-th best score; so it is exact
whatever the clusters are like.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import shards
from tidemill.llm.common import discard, materialize

#: Rows of a cluster on average, and rounds of k-means.
CLUSTER_ROWS = 128
ROUNDS = 6
_ROWS_AT_ONCE = 1 << 20  # scores that one step of a search holds


def k_means(values: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """The number of each row's cluster; equal rows are in the same one."""
    points = values / max(np.abs(values).max(initial=0), 1.0)
    start = np.random.default_rng(11).permutation(len(points))[:clusters]
    centres = points[start]
    for _ in range(rounds):
        near = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return near


class InvertedLists:
    """The rows of one shard by cluster, with centroids and radii."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, cluster_rows: int = CLUSTER_ROWS):
        names, codes = np.unique(labels, return_inverse=True)
        self.codes = {name: i for i, name in enumerate(names)}
        order = np.lexsort((codes, ids))
        ids, labels, values = ids[order], codes[order], values[order]
        near = k_means(values, max(1, -(-len(ids) // cluster_rows)))
        by = np.argsort(near, kind="stable")
        self.place = by  # of a row among all of the shard by id
        self.ids, self.labels, self.values = ids[by], labels[by], values[by]
        heads = np.flatnonzero(np.append(True, near[by][1:] != near[by][:-1]))
        self.heads = np.append(heads, len(ids))
        self.centroids = np.add.reduceat(self.values, heads, axis=0) / np.diff(self.heads)[:, None]
        gaps = self.values - np.repeat(self.centroids, np.diff(self.heads), axis=0)
        self.radii = np.maximum.reduceat(np.sqrt((gaps**2).sum(1)), heads)
        self.largest = np.abs(self.values).max(initial=0)

    def _scores(self, queries: np.ndarray, rows: slice) -> np.ndarray:
        """Exact scores as longs."""
        if np.abs(queries).max(initial=0) * self.largest * max(queries.shape[1], 1) < shards.EXACT:
            return (queries @ self.values[rows].T).astype(np.int64)
        return np.stack([shards.exact_products(self.values[rows], q) for q in queries])

    def search(self, queries, own, labels, same: bool, low, high, k: int, least) -> list[tuple[int, int, int]]:
        """(query's number, score, id) of each query's best ``k`` rows here, and maybe others of the same scores.

        ``own`` ids are left out.  Rows have the query's label (``same``) or another one, and a
        score from ``low`` to ``high``.  Only scores of at least ``least`` matter.
        """
        count, n = len(queries), len(self.ids)
        labels = np.array([self.codes.get(v, -1) for v in labels])
        middle = queries @ self.centroids.T
        reach = np.sqrt((queries**2).sum(1))[:, None] * self.radii
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6 * np.abs(queries).max(axis=1, initial=0)[:, None]  # for rounding
        upper, lower = middle + reach + slack, middle - reach - slack
        outside = (upper < low[:, None]) | (lower > high[:, None])
        order = np.argsort(-upper, axis=1, kind="stable")
        kth = np.maximum(np.asarray(least, np.float64), low.astype(np.float64))
        scores, rows = np.full((count, k), shards.LEAST), np.full((count, k), n)
        live = np.arange(count)
        for turn in range(order.shape[1]):
            cluster = order[live, turn]
            going = upper[live, cluster] >= kth[live]  # bounds fall, so the others have ended
            live, cluster = live[going], cluster[going]
            if not len(live):
                break
            visit = ~outside[live, cluster]
            visitors, cluster = live[visit], cluster[visit]
            by = np.argsort(cluster, kind="stable")
            visitors, cluster = visitors[by], cluster[by]
            heads = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1])) if len(cluster) else []
            for first, last in zip(heads, np.append(heads[1:], len(cluster)) if len(cluster) else []):
                inside = slice(self.heads[cluster[first]], self.heads[cluster[first] + 1])
                step = max(1, _ROWS_AT_ONCE // (inside.stop - inside.start))
                for at in range(first, last, step):
                    some = visitors[at : min(at + step, last)]
                    found = self._scores(queries[some], inside)
                    fits = (self.labels[inside] == labels[some, None]) == same
                    fits &= (self.ids[inside] != own[some, None]) & (found >= low[some, None]) & (found <= high[some, None]) & (found >= kth[some, None])
                    hit = np.flatnonzero(fits.any(1))
                    if not len(hit):
                        continue
                    some, found, fits = some[hit], found[hit], fits[hit]
                    places = np.where(fits, self.place[inside], n)
                    found = np.where(fits, found, shards.LEAST)
                    both, where = np.concatenate([scores[some], found], axis=1), np.concatenate([rows[some], places], axis=1)
                    best = np.lexsort((where, ~both), axis=1)[:, :k]  # ~ turns the order of longs around
                    scores[some], rows[some] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
                    full = rows[some, k - 1] < n
                    kth[some[full]] = np.maximum(kth[some[full]], scores[some[full], k - 1])
        by_place = np.empty(n, np.int64)
        by_place[self.place] = self.ids
        q, slot = np.nonzero(rows < n)
        return [(int(a), int(s), int(i)) for a, s, i in zip(q, scores[q, slot], by_place[rows[q, slot]])]


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: Column | str = "label",
    shard_rows: int = shards.SHARD_ROWS,
) -> DataFrame:
    """For each row that ``anchors`` selects and each of its positives, the closest rows of other labels within a window.

    Scores are inner products of the integers floor(256 x).  An anchor's positives are its best
    ``positives`` other rows of its label; the negatives of a positive are the best
    ``negatives`` rows of other labels whose score is between ``least`` and ``most`` per cent of
    the positive's.  Ties go to the smaller id.

    Gives anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    Rows whose id, label or vector is null, or whose vector holds null or a component that isn't
    finite, take no part.  Vectors meet only those of the same length.  Repeated rows count each;
    of a repeated anchor id the least vector, then the least label, is the anchor.  Anchors without positives or negatives have
    no rows; no rows give an empty table.  Scores beyond a long count as its limits.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    vector = F.col(vector_col).cast("array<double>")
    source = vectors.where(shards.finite(F.col(vector_col)) & F.col(id_col).isNotNull() & label.isNotNull())
    fields = [F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vector.alias("vector")]
    rows = source.select(*fields).withColumn("dim", F.size("vector"))
    asked = source.where(anchors).select(*fields).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("least"))
    asked = materialize(asked.select("id", "least.*").withColumn("dim", F.size("vector")), "anchors")

    index, parts = shards.deal(rows, shard_rows, "cluster-lists", lambda pdf: InvertedLists(pdf["id"].to_numpy(), pdf["label"].to_numpy(object), shards.floored(pdf["vector"])))

    def found(queries: DataFrame, name: str, same: bool, k: int, keys: list[str], schema: str) -> DataFrame:
        """The best ``k`` of each row of ``queries``; ``keys`` are the columns that say which one it is."""

        def block(pdf: pd.DataFrame):
            low, high = pdf["low"].to_numpy(np.int64), pdf["high"].to_numpy(np.int64)
            return pdf[keys], pdf["id"].to_numpy(), pdf["label"].to_numpy(object), low, high, shards.floored(pdf["vector"])

        def search(shard, block, held):
            named, own, labels, low, high, values = block
            if shard is not None:
                shards.merged(held, shard.search(values, own, labels, same, low, high, k, shards.kth(held, len(own), k)), k)
                return None
            out = [(q, i, -s) for q, best in held.items() for s, i in best]
            at = [q for q, _, _ in out]
            return named.iloc[at].reset_index(drop=True).assign(vec_id=[i for _, i, _ in out], score=[s for _, _, s in out])

        blocks, counts = shards.deal(queries, shards.BLOCK_QUERIES, name, block)
        some = shards.meet(index, parts, blocks, counts, search, f"{schema}, vec_id long, score long")
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anywhere = asked.withColumns({"low": F.lit(shards.LEAST), "high": F.lit(shards.MOST)})
    best = materialize(found(anywhere, "anchor-blocks", True, positives, ["id"], "id long"), "positives")
    # bounds of the window in whole numbers; decimals don't overflow
    per_cent = lambda share: F.col("score").cast("decimal(20,0)") * F.lit(share).cast("decimal(10,0)") / 100
    windows = best.select("id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive"), F.col("score").alias("reached"), F.ceil(per_cent(least)).cast("long").alias("low"), F.floor(per_cent(most)).cast("long").alias("high"))
    windows = asked.hint("merge").join(windows.where("low <= high"), "id")  # a file's size, small for copied vectors, mustn't decide on a broadcast
    keys = ["id", "nth", "positive", "reached"]
    out = found(windows, "window-blocks", False, negatives, keys, "id long, nth int, positive long, reached long")
    discard(asked)
    return out.select(
        F.col("id").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("reached").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
