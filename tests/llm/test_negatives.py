import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_topk import single, whole
from tidemill.llm import negatives, shards


def brute_force(rows, every=10):
    good = [(i, whole(v), k) for i, v, k in rows if None not in (i, v, k) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, k in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, str(k))), (v, str(k)))
    out = []
    for a, (av, ak) in anchors.items():
        scored = sorted((-min(max(sum(x * y for x, y in zip(v, av)), shards.LEAST), shards.MOST), i, str(k)) for i, v, k in good if i != a and len(v) == len(av))
        for s, p, _ in [x for x in scored if x[2] == ak][:5]:
            fits = [(t, i) for t, i, k in scored if k != ak and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits[:10])]
    return sorted(out)


def run(spark, rows, every=10, kind="float", **options):
    df = spark.createDataFrame([(i, v, k, 0, "x") for i, v, k in rows], f"vec_id long, embedding array<{kind}>, label int, id int, rank string")
    found = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("noise", [0.02, 0.3, 3.0])
def test_equals_brute_force_over_shards(spark, noise):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(9, 12)) / 3
    rows = [(i, single(centres[i % 9] + noise * rng.normal(size=12) / 3), int(rng.integers(0, 4))) for i in range(600)]
    want = brute_force(rows)
    assert want and run(spark, rows, shard_rows=150) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(10)
    rows = [(i, single(rng.normal(size=4)), i % 3) for i in range(80)]
    rows += [(i, rows[5][1], i % 2) for i in range(100, 350)]  # one vector, two labels
    rows += [(500, None, 1), (510, [1.0] * 4, None), (None, [1.0] * 4, 1), (520, [math.nan] * 4, 1), (530, [None] * 4, 1), (540, [0.0] * 4, 2), (541, [0.0] * 4, 2), (542, [0.0] * 4, 1)]
    rows += [(20, single(rng.normal(size=4)), 1), (30, rows[30][1], 2), (550, [2.0, 1.0], 1), (551, [2.0, 1.0], 1), (552, [1.0, 1.0], 2), (560, [], 1), (561, [], 1), (562, [], 2), (570, [1.0], 1)]
    assert run(spark, rows, shard_rows=60) == [r for r in brute_force(rows)]


def test_scores_beyond_a_long(spark):
    rows = [(i, [float(i + 1) * 10.0 ** (i % 12), 1.0], i % 2) for i in range(40)]
    assert run(spark, rows, kind="double") == brute_force(rows)


def test_negative_scores_have_no_window(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2)]
    assert run(spark, rows) == [] == brute_force(rows)
    assert run(spark, []) == []


def test_bounds_hold_all_rows_of_a_cluster():
    rng = np.random.default_rng(12)
    values = np.floor(256 * rng.normal(size=(500, 6)))
    lists = negatives.InvertedLists(np.arange(500), np.array(["a"] * 500, object), values, cluster_rows=20)
    assert len(lists.radii) > 5 and sorted(lists.ids) == list(range(500))
    for c, (a, b) in enumerate(zip(lists.heads, lists.heads[1:])):
        assert (np.linalg.norm(lists.values[a:b] - lists.centroids[c], axis=1) <= lists.radii[c] + 1e-6).all()


def test_no_block_of_queries_is_broadcast(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, single(rng.normal(size=4)), i % 3) for i in range(200)], "vec_id long, embedding array<float>, label int")
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, shard_rows=40)
    plan = found._jdf.queryExecution().toString()
    assert "payload" in plan and "Broadcast" not in plan


def test_no_anchor_is_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, single(rng.normal(size=4)), i % 3) for i in range(200)], "vec_id long, embedding array<float>, label int")
    plans, deal = {}, shards.deal

    def noted(rows, most, name, work):
        out = deal(rows, most, name, work)
        plans[name] = rows._jdf.queryExecution().toString()
        return out

    monkeypatch.setattr(shards, "deal", noted)
    found = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, shard_rows=40)
    assert found.count() and "SortMergeJoin" in plans["window-blocks"]
    assert not any("BroadcastExchange" in p for p in plans.values())
