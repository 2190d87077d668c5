"""Vectors in shards of bounded size, and blocks of queries that meet every shard.

Rows are dealt to shards by a hash of their id and vector, so shards are even whatever ids,
labels or copies there are.  Each shard becomes one payload (an index over its rows), each
block of queries another one; a task searches a tile of shards and blocks and keeps the best
of each query, so that what later shards must beat is known.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bound_batches, materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
#: Tasks for each core of the cluster, so that slow ones don't hold up the others.
_TASKS_A_CORE = 8

#: Longs that scores beyond a long count as.
LEAST, MOST = -(2**63), 2**63 - 1
#: Sums of products below this are exact in double precision, also after a further factor of 2^12.
EXACT = 2.0**50


def finite(vector: Column) -> Column:
    """True for vectors that aren't null and hold no component that is null or not finite."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def stacked(column: pd.Series) -> np.ndarray:
    """Equally long lists as a matrix of doubles, also of no columns."""
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def floored(column: pd.Series) -> np.ndarray:
    """floor(256 * x) of each component x; a double holds it exactly."""
    return np.floor(256 * stacked(column))


def exact_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer rows and an integer query, as longs; those beyond a long count as its limits."""
    if np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * max(rows.shape[1], 1) < EXACT:
        return (rows.astype(np.float64) @ query).astype(np.int64)
    whole = [int(q) for q in query]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in rows)
    return np.array([min(max(s, LEAST), MOST) for s in sums], np.int64)


def deal(rows: DataFrame, most: int, name: str, work: Callable[[pd.DataFrame], object]) -> tuple[DataFrame, dict[int, int]]:
    """``rows`` (id, vector, dim and more) in parts of about ``most`` rows, as a table (dim, part, payload); and the parts of each dim.

    ``work`` makes a part's payload of its rows.
    """
    parts = {r["dim"]: -(-r["count"] // most) for r in rows.groupBy("dim").count().collect()}
    number = F.coalesce(*(F.when(F.col("dim") == d, F.lit(n)) for d, n in parts.items()), F.lit(1))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "vector"), number).cast("int")).repartition(max(sum(parts.values()), 1), "dim", "part")

    def made(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "payload": [pickle.dumps(work(pdf))]})

    return materialize(dealt.groupBy("dim", "part").applyInPandas(made, "dim int, part int, payload binary"), name), parts


#: Shards, and blocks of queries, that meet in one task at most.
MOST_SIDE = 16


def tiled(shards: dict[int, int], counts: dict[int, int], wanted: int) -> dict[int, tuple[int, int, int, int, int]]:
    """For each dim (first tile, rows and columns of tiles, shards and blocks of a tile at most): about ``wanted`` tiles of all, or as many as there are pairs.

    Shards are some times as large as blocks, so tiles are wider than high.
    """
    out, first = {}, 0
    pairs = sum(n * shards.get(d, 0) for d, n in counts.items())
    each = max(1, pairs // max(wanted, 1))
    for d, n in counts.items():
        if not n or not shards.get(d):
            continue
        wide = min(n, MOST_SIDE, max(1, math.isqrt(3 * each) if each > 1 else 1))
        high = min(shards[d], MOST_SIDE, max(1, each // wide))
        down, across = -(-shards[d] // high), -(-n // wide)
        out[d] = (first, down, across, high, wide)
        first += down * across
    return out


def meet(index: DataFrame, shards: dict[int, int], blocks: DataFrame, counts: dict[int, int], search: Callable, schema: str) -> DataFrame:
    """What ``search`` finds where every block meets every shard of vectors as long as its own.

    ``search(shard, block, held)`` may put what it has found so far for a block into the dict
    ``held``; ``search(None, block, held)`` ends a block and returns a frame of ``schema``.

    A task takes a tile of some blocks and shards: it holds the blocks, and the shards pass by.
    Payloads go to tiles by one shuffle and never to the driver.
    """
    spark = index.sparkSession
    tiles = tiled(shards, counts, _TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    bound_batches(spark)
    by_dim = lambda i: F.coalesce(*(F.when(F.col("dim") == d, F.lit(t[i])) for d, t in tiles.items()), F.lit(1))
    first, down, across, high, wide = (by_dim(i) for i in range(5))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = lambda n: n.cast("int")
    met = F.col("dim").isin(*tiles) if tiles else F.lit(False)
    rows = index.where(met).select("dim", "part", "payload", each(across).alias("other"))
    rows = rows.select(whole(first + F.floor(F.col("part") / high) * across + F.col("other")).alias("tile"), F.lit(1).alias("kind"), "part", "payload")
    columns = blocks.where(met).select("dim", "part", "payload", each(down).alias("other"))
    columns = columns.select(whole(first + F.col("other") * across + F.floor(F.col("part") / wide)).alias("tile"), F.lit(0).alias("kind"), "part", "payload")
    number = max(sum(t[1] * t[2] for t in tiles.values()), 1)

    def run(batches):
        at, asked = None, []  # the tile's blocks, each with what it has found
        for pdf in batches:
            for tile, kind, raw in zip(pdf["tile"], pdf["kind"], pdf["payload"]):
                if at != tile:
                    for block, held in asked:
                        yield search(None, block, held)
                    at, asked = tile, []
                payload = pickle.loads(raw)
                if kind == 0:
                    asked.append((payload, {}))
                    continue
                for block, held in asked:
                    search(payload, block, held)
        for block, held in asked:
            yield search(None, block, held)

    return columns.unionAll(rows).repartitionById(number, "tile").sortWithinPartitions("tile", "kind", "part").mapInPandas(run, schema)


def merged(held: dict, found: list[tuple[int, int, int]], k: int) -> None:
    """Put (query's number, score, id) into ``held``: for each query its best ``k`` as (-score, id), in order."""
    fresh: dict[int, list] = {}
    for q, score, i in found:
        fresh.setdefault(q, []).append((-score, i))
    for q, more in fresh.items():
        held[q] = sorted(held.get(q, []) + more)[:k]


def kth(held: dict, count: int, k: int) -> np.ndarray:
    """The ``k``-th best score of each query so far; minus infinity where there are fewer."""
    return np.array([-held[q][k - 1][0] if len(held.get(q, ())) >= k else -np.inf for q in range(count)], np.float64)
