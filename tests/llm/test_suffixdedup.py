import random

import numpy as np
import pytest

from tidemill.llm import suffixdedup


def plain(rows, window=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - window + 1):
                w = b[i : i + window]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if d is not None and first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def rows_with_repeats(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "éa", "tion", "x", "for", "\n", "quick", "brown"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    passages = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for _ in range(n):
        parts = [text(rng.randint(0, 30)), *(rng.choice(passages) for _ in range(rng.randint(0, 2))), text(rng.randint(0, 20))]
        if rng.random() < 0.2:
            parts.append("For " * rng.randint(5, 80))
        rows.append(" ".join(parts))
    rows += [rows[3], rows[3], rows[5][:200], "a" * 49, "a" * 49, "a" * 50, "a" * 120, "", "  "]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, code long, _cut string")
    found = suffixdedup.remove_repeats(docs)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


def test_against_brute_force(spark):
    rows = rows_with_repeats(1)
    check(spark, [*rows, rows[0], (None, rows[1][1]), (2000, None), (2000, None)])


def test_hot_grams_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "HOT_LEAST", 3)
    monkeypatch.setattr(suffixdedup, "_FLUSH_BYTES", 4000)
    monkeypatch.setattr(suffixdedup, "_CHUNK", 1000)
    check(spark, rows_with_repeats(2, 90))


def test_empty_table(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_repeat_groups_are_the_maximal_repeats(seed):
    rng = random.Random(seed)
    data = bytes(rng.choices(b"ab", k=60))
    starts = np.arange(60)
    left = np.array([-1, *data[:-1]], np.int64)
    order, (low, high, length) = suffixdedup.repeat_groups(data, starts, np.full(60, 60), left, np.zeros(60, np.uint64), 3)
    found = {(data[order[a] : order[a] + n], tuple(sorted(order[a : b + 1].tolist()))) for a, b, n in zip(low, high, length)}
    want = set()
    for n in range(3, 60):
        for s in {data[i : i + n] for i in range(61 - n)}:
            at = [i for i in range(61 - n) if data[i : i + n] == s]
            lefts, rights = {left[i] for i in at}, {data[i + n] if i + n < 60 else -i - 1 for i in at}
            if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                want.add((s, tuple(at)))
    assert found == want


def test_windows_under_one_key_are_told_apart_by_their_bytes():
    raw = np.frombuffer(b"a" * 50 + b"b" * 50 + b"a" * 50 + b"b" * 50, np.uint8)
    at, doc = np.array([0, 50, 100, 150]), np.array([1, 2, 3, 2])
    order, later = suffixdedup._repeated(raw, at, np.zeros(4, np.uint64), doc)
    assert not later[order.argsort()][[0, 1, 3]].any()  # a repeat between other bytes is left to the next step
    order, later = suffixdedup._repeated(raw, at, np.array([1, 2, 1, 2], np.uint64), doc)
    assert later[order.argsort()].tolist() == [False, False, True, False]
