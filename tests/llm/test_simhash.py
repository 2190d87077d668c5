import random
import re

import xxhash

from tidemill.llm import simhash
from tidemill.llm.common import shared_dir


def plain_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, n, radius):
    prints = [plain_fingerprint(t, n) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc, _), k in zip(rows, label):
        least[k] = doc if least.get(k) is None else least[k] if doc is None else min(least[k], doc)
    return [(doc, f"{p:016x}", least[k]) for (doc, _), p, k in zip(rows, prints, label)]


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}É" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  \t\n"), (3, "one"), (4, "ONE"), (5, "two words"), (5, "two words")]
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 400))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 100 - 7 * k, " ".join(copy)))
    return [*rows, (None, "one")]


def test_components_match_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    for tree_size in (simhash.TREE_SIZE, 2):
        found = simhash.simhash_components(docs, words=3, radius=2, tree_size=tree_size).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_components(rows, 3, 2)))


def test_clustered_fingerprints_with_small_trees(spark):
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    for radius in (1, 2, 4):
        links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, tree_size=8)
        groups = {r["node"]: r["root"] for r in simhash.connected_components(links).collect()}
        label = {v: v for v in signed}
        changed = True
        while changed:
            changed = False
            for a in signed:
                for b in signed:
                    if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius and label[b] < label[a]:
                        label[a], changed = label[b], True
        assert {v: groups.get(v, v) for v in signed} == label


def shingles(text, n=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {b" ".join(words)}


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        texts.append((k, " ".join(base)))
        for _ in range(k % 3):
            copy = list(base)
            for _ in range(max(1, len(base) // 120)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((k, " ".join(copy).upper()))
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(900, None), (901, ""), (None, texts[0][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    same = caught = 0
    for i, (k, t) in enumerate(texts):
        for j in range(i):
            a, b = shingles(t), shingles(texts[j][1])
            if len(a & b) >= 0.85 * len(a | b):
                same, caught = same + 1, caught + (group[i] == group[j])
            elif len(a & b) < 0.5 * len(a | b):
                assert group[i] != group[j]
    assert same > 30 and caught >= 0.95 * same and group[901] == 900 and group[None] == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, {*group.values(), None}))


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for k in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 14, 30, 120, 300]))]
        texts.append(" ".join(base))
        # five shingles change with each word that does: similarities between 0.6 and 0.9
        share = rng.uniform(0.05, 0.25)
        texts.append(" ".join(base[: round(len(base) * (1 - share))]))
        texts.append(" ".join([*base, *(rng.choice(vocabulary) for _ in range(round(len(base) * share)))]))
    # a shingle that makes up over half of a text doesn't make texts alike
    for _ in range(4):
        texts.append(" ".join(["again"] * 200 + [rng.choice(vocabulary) for _ in range(80)]))
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (simhash._SHARD_PAIRS, 0):
        monkeypatch.setattr(simhash._candidates, "__defaults__", (most, 3))
        group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}
        wrong = [i for i in range(len(texts)) if group[i] < label[i]]
        missed = [i for i in range(len(texts)) if group[i] > label[i]]
        assert pairs > 100 and not wrong and len(missed) <= 2


def test_empty_table(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert shared_dir(spark)
