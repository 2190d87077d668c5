import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import shards, topk


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def usable(rows):
    return [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_force(rows, every, k):
    good = usable(rows)
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    limit = lambda s: min(max(s, shards.LEAST), shards.MOST)
    out = {}
    for q, qv in asked.items():
        scored = sorted((-limit(sum(a * b for a, b in zip(v, qv))), i) for i, v in good if i != q and len(v) == len(qv))
        if scored:
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, every=10, k=5, kind="float", **options):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int, id int")
    found = {}
    for r in topk.exact_top(df, F.col("vec_id") % every == 0, k, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def single(v):
    return np.asarray(v, np.float32).tolist()


@pytest.mark.parametrize("noise", [0.0, 0.05, 0.5, 5.0])
def test_equals_brute_force_over_shards(spark, noise):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) / 4
    rows = [(i, single(centres[i % 12] + noise * rng.normal(size=16) / 4)) for i in range(900)]
    assert run(spark, rows, shard_rows=200) == brute_force(rows, 10, 5)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, single(rng.normal(size=5))) for i in range(60)]
    rows += [(i, rows[7][1]) for i in range(100, 400)]  # copies tie
    rows += [(1000, [0.0] * 5), (1001, [0.0] * 5), (1010, None), (1020, [math.nan] + [1.0] * 4), (1030, [None] + [1.0] * 4), (1040, [math.inf] * 5), (None, [1.0] * 5)]
    rows += [(20, single(rng.normal(size=5))), (30, rows[30][1])]  # repeated ids
    rows += [(1050, [1.0, 2.0]), (1051, [2.0, 1.0]), (1060, []), (1061, []), (1070, [5.0])]
    assert run(spark, rows, shard_rows=100) == brute_force(rows, 10, 5)
    assert 1070 not in run(spark, rows)


def test_scores_beyond_a_long(spark):
    rows = [(i, [float(i) * 10.0 ** (i % 36), -1e30 if i % 3 else 2e-3]) for i in range(40)]
    assert run(spark, rows, kind="double") == brute_force(rows, 10, 5)


def test_empty_table(spark):
    assert run(spark, []) == {} and run(spark, [(1, [1.0])]) == {} and run(spark, [(10, [1.0])]) == {}


def test_search_stops_by_proof():
    """Rows far below the best are never scored exactly, and what is given holds the best."""
    rng = np.random.default_rng(8)
    values = np.floor(64 * rng.normal(size=(4000, 8)))
    values[::100] *= 6
    index, ids = topk.ImpactIndex(np.arange(4000), values), np.arange(4000)
    for q in range(0, 4000, 97):
        found, scores = index.search(q, values[q], 5)
        want = values @ values[q]
        want[q] = -np.inf
        best = ids[np.lexsort((ids, -want))[:5]]
        assert set(best) <= set(found) and q not in found and len(found) < 1000
        assert (scores == want[found]).all()
        above, _ = index.search(q, values[q], 5, least=float(want[best[0]]) + 1)
        assert len(above) <= 500
