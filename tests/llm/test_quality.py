import itertools

import numpy as np

from tidemill.llm import quality


def test_estimate_recovers_known_accuracies():
    rng = np.random.default_rng(0)
    n, k = 40_000, len(quality.LABELLERS)
    good = rng.random(n) < 0.8
    right = np.where(good[:, None], 0.97, rng.uniform(0.55, 0.9, k))
    vote = np.where(rng.random((n, k)) < right, good[:, None], ~good[:, None]).astype(int)
    vote[rng.random((n, k)) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(vote @ quality._BASE, return_counts=True)
    model = quality.estimate(patterns, counts.astype(float))
    assert abs(model["prior"] - 0.8) < 0.03
    accuracy = model["table"][0, :, quality.BAD]
    assert np.abs(accuracy - right[~good].mean(0)).max() < 0.04
    found = dict(zip(patterns.tolist(), model["posterior"]))
    assert np.mean((np.array([found[p] for p in (vote @ quality._BASE).tolist()]) > 0.5) == good) > 0.97


def test_statistics_match_plain_counts():
    texts = ["The cat sat. The cat!", "a | b | c", "", "WORD!! WORD!! x", "é %% 12"]
    stats, grams = quality.statistics([t.encode() for t in texts])
    for t, row in zip(texts, stats):
        words = t.encode().split()
        n = max(len(words), 1)
        assert row[0] == len(words)
        assert row[1] == (t.count("|") + t.count("\t")) / n
        assert row[4] == sum(a == b for a, b in itertools.pairwise(words)) / n
        assert row[5] == max(map(words.count, words), default=0) / n
        assert row[10] == len(set(itertools.pairwise(words))) / max(len(words) - 1, 1)
        assert row[6] == t.count("!") / n
        assert row[9] == sum(w[-1:] in b"!|%" for w in words) / n
    assert (grams.sum(1) == [max(len(g) - 3, 0) for g in ([0] * 13, [0] * 9, [], [0] * 10, [0] * 7)])[[1, 2]].all()


def test_labels_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "x " * 200_000), (None, "Plain words of a text, and more."), (9001, None)], docs.schema)
    docs = docs.unionByName(odd)
    model = quality.train(docs, sample_docs=2000)
    rows = {r["doc_id"]: r for r in quality.score(docs.withColumnRenamed("doc_id", "id").withColumn("quality", docs["text"]).selectExpr("id as doc_id", "text", "quality"), model).collect()}
    assert [rows[i]["quality"] for i in (9001, 9002, 9003)] == [0.0] * 3
    assert rows[9004]["quality"] < 0.5
    right = [(rows[d]["quality"] >= 0.5) == bool(q) for d, q in labels.items()]
    kept = [rows[d]["quality"] >= 0.5 for d, q in labels.items() if q]
    assert np.mean(right) > 0.95 and np.mean(kept) > 0.98


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(none, quality.train(none)).collect() == []


def test_scorer_takes_the_whole_sample_and_all_rounds():
    assert quality.train.__defaults__[-1] == 6000
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, quality.BUCKETS)).astype(np.float32)
    target = (x[:, 0] > 0).astype(float)
    assert np.array_equal(quality.fit_scorer(x, target), quality.fit_scorer(x, target, rounds=300))


def plain_em(patterns, rounds=100):
    """Expectation-maximisation one vote at a time; the votes of each pattern and its count."""
    likely = [0.1 if quality.BAD in votes else 0.95 for votes, _ in patterns]
    for _ in range(rounds):
        weight = [sum((p if c else 1 - p) * n for p, (_, n) in zip(likely, patterns)) for c in (0, 1)]
        prior = [(w + 1) / (sum(weight) + 2) for w in weight]
        table = {}
        for c in (0, 1):
            for k in range(len(quality.LABELLERS)):
                seen = {v: 0.5 + sum((p if c else 1 - p) * n for p, (votes, n) in zip(likely, patterns) if votes[k] == v) for v in (quality.BAD, quality.GOOD)}
                for v, x in seen.items():
                    table[c, k, v] = x / sum(seen.values())
        for i, (votes, _) in enumerate(patterns):
            odds = list(prior)
            for c in (0, 1):
                for k, v in enumerate(votes):
                    odds[c] *= table[c, k, v] if v != quality.ABSTAIN else 1.0
            likely[i] = odds[1] / sum(odds)
    return likely


def test_training_on_documents_matches_plain_versions(spark):
    """The posterior by EM one vote at a time, and a fit in double precision, over all documents."""
    from collections import Counter

    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    stats, grams = quality.statistics([(t or "").encode() for t in rows])
    votes = quality.votes(stats)
    counts = Counter(map(tuple, votes.tolist()))
    want = dict(zip(counts, plain_em(list(counts.items()))))
    model = quality.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for pattern, likely in want.items():
        assert abs(model["posterior"][int(np.dot(pattern, quality._BASE))] - likely) < 1e-6
    x = np.concatenate([quality.features(stats, grams).astype(np.float16).astype(np.float64), np.ones((len(rows), 1))], axis=1)
    target = np.array([want[tuple(v)] for v in votes.tolist()])
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for i in range(1, 301):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    scores = 1 / (1 + np.exp(-(x @ w)))
    ours = 1 / (1 + np.exp(-(x @ model["weights"])))
    assert np.abs(scores - ours).max() < 5e-3 and ((scores >= 0.5) == (ours >= 0.5)).mean() > 0.995
