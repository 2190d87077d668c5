import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann


def brute_force(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    asked = {}
    for i, v in good:
        if i % 20 == 0:
            asked[i] = min((asked.get(i, v), v), key=lambda x: (len(x), x.tolist()))
    for q, qv in asked.items():
        scored = sorted((-float(v @ qv), i) for i, v in good if i != q and len(v) == len(qv))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    data = (centres[rng.integers(0, 8, 2400)] + rng.normal(size=(2400, 24))) * rng.uniform(0.5, 2, (2400, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]
    found, want = run(spark, rows, shard_rows=700), brute_force(rows, 20)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    for q, got in found.items():
        assert got == sorted(got, key=lambda x: (-x[1], x[0])) and len(got) == 20


@pytest.mark.parametrize("noise", [0.05, 0.2, 0.5])
@pytest.mark.parametrize("clusters", [64, 700])
def test_recall_on_tight_clusters(clusters, noise):
    """Shards of the production size, where few edges lead from one cluster to another."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(clusters, 64))
    data = centres[np.arange(8192) % clusters] + noise * rng.normal(size=(8192, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    ids = np.arange(0, 8192, 40)
    hits, least = {int(i): 0 for i in ids}, data[ids] @ data.T
    least[np.arange(len(ids)), ids] = -np.inf
    want = np.argsort(-least, axis=1)[:, :20]
    for q, v, _ in ann.Shard(np.arange(8192), data).search(ids, data[ids], 20, ann.SEARCH_BEAM):
        for i in set(q):
            hits[int(i)] = len(set(v[q == i]) & set(want[i // 40]))
    assert sum(hits.values()) >= 0.97 * want.size and min(hits.values()) >= 10


def test_recall_over_several_shards_of_clusters(spark):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(40, 16))
    data = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(data)]
    found, want = run(spark, rows, shard_rows=800), brute_force(rows, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))


def test_norm_outliers():
    rng = np.random.default_rng(6)
    data = rng.normal(size=(2000, 24))
    data /= np.linalg.norm(data, axis=1)[:, None]
    ids = np.arange(2000)
    for factor in (1e4, 1e8, 1e25):
        rows = data.copy()
        rows[77] *= factor
        queries = data[:200]
        want = np.argsort(-np.where(ids[:200, None] == ids, -np.inf, queries @ rows.T), axis=1)[:, :20]
        hits = 0
        for q, v, _ in ann.Shard(ids, rows).search(ids[:200], queries, 20, ann.SEARCH_BEAM):
            hits += sum(len(set(v[q == i]) & set(want[i])) for i in set(q))
        assert hits >= 0.97 * want.size, (factor, hits)


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(50)]
    rows += [(i, rows[7][1]) for i in range(100, 160)]
    rows += [(60, None), (80, [0.0] * 5), (200, [float("nan")] + [1.0] * 4), (220, [None] + [1.0] * 4), (240, [float("inf")] + [1.0] * 4), (None, [1.0] * 5), (20, rows[20][1])]
    rows += [(40, max(rows[40][1], [1.0] * 5))]  # the least vector of a repeated id asks
    rows += [(300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [5.0])]
    found, want = run(spark, rows, k=20), brute_force(rows, 20)
    assert 320 not in found and not want.pop(320)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(found[q], want[q]))


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_no_block_of_queries_is_broadcast(spark):
    rng = np.random.default_rng(14)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(300, 4)).tolist())], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=100)
    plan = found._jdf.queryExecution().toString()
    assert "payload" in plan and "Broadcast" not in plan
