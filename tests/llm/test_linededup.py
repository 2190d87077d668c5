import random

import pytest

from tidemill.llm import linededup
from tidemill.llm.linededup import words_of_line


def plain(rows, threshold=0.8, least=3):
    seen, out = [], {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            w = words_of_line(line)
            if len(w) >= least:
                same = any(len(w & o) >= threshold * len(w | o) - 1e-9 for o in seen)
                seen.append(w)
                if same:
                    continue
            kept.append(line)
        out[d] = None if t is None else "\n".join(kept)
    return sorted((repr((d, t if d is None else out[d])) for d, t in rows))


def some_rows(seed, n=70):
    rng = random.Random(seed)
    common = ["the", "of", "Und", "é", "|"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(400)}"
    line = lambda k: " ".join(word() for _ in range(k))
    stock = [line(rng.randint(1, 40)) for _ in range(25)]
    texts = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.5:
                lines.append(line(rng.randint(0, 30)))
            else:
                words = rng.choice(stock).split()
                for _ in range(rng.randint(0, 3)):
                    words[rng.randrange(len(words))] = word()
                rng.shuffle(words)
                lines.append("  ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
        texts.append("\n".join(lines))
    ids = rng.sample(range(500), n)
    return list(zip(ids, texts))


def run(spark, rows, threshold=0.8, least=3):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, _gone int, _id string")
    found = linededup.drop_repeated_lines(docs, threshold=threshold, least_words=least)
    assert found.columns == docs.columns
    return sorted(repr((r["doc_id"], r["text"])) for r in found.collect())


def test_sketch_follows_the_input():
    small, hot = linededup._sketch_shape(1 << 30)
    assert (small, hot) == (24, int(linededup._level(linededup.HOT_WORD)))
    for size in (1 << 40, 1 << 44, 10**14, 10**16):
        bits, hot = linededup._sketch_shape(size)
        assert 24 <= bits <= 26 and hot >= int(linededup._level(linededup.HOT_WORD))
        assert linededup._level((size // 8) >> bits) < hot  # a slot of mean size is never hot


def test_sums_fold_one_payload_at_a_time():
    import numpy as np
    import pandas as pd

    from tidemill.llm.common import pack, unpack

    made = [(b, k, np.arange(5, dtype=np.uint32) * (b + k)) for b in range(3) for k in range(4)]
    frames = (pd.DataFrame({"part": [b], "some": [k % 2], "payload": [pack(x)]}) for b, k, x in sorted(made, key=lambda r: (r[0], r[1] % 2)))
    got = {tuple(key): total.tolist() for key, total in linededup._summed(frames, ["part", "some"])}
    assert got == {(b, p): [sum(i * (b + k) for k in (p, p + 2)) for i in range(5)] for b in range(3) for p in range(2)}
    assert unpack(pack(np.arange(3)))[0].tolist() == [0, 1, 2]


def test_sketch_counts_all_documents(spark):
    import numpy as np

    docs = spark.createDataFrame([(i, "common " * 40 + f"rare{i}") for i in range(50)], "_id long, _text string").repartition(9)
    sketch = linededup._word_sketch(docs, 24)
    words, _ = linededup.word_hashes(np.frombuffer(b"common rare7 ", np.uint8))
    assert [int(sketch[int(w) >> 40]) for w in words] == [int(linededup._level(2000)), 0] and len(sketch) == 1 << 24


def test_against_brute_force(spark):
    rows = some_rows(1)
    rows += [rows[0], (None, rows[1][1]), (900, None), (900, None), (901, ""), (902, "\n\n"), (903, "a b c " * 30_000), (904, "a b c"), (905, "a b"), (906, "a b"), (907, rows[3][1]), (908, rows[3][1] + "\nA b C c"), (909, rows[3][1] + "\nA b C c")]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize(("threshold", "least"), [(0.5, 1), (0.6, 3), (0.95, 2), (1.0, 3)])
def test_other_thresholds(spark, threshold, least):
    rows = some_rows(3, 60) + [(1001, "alpha beta gamma"), (1002, "alpha beta gamma delta"), (1003, "one two three"), (1004, "one two four"), (1005, "x"), (1006, "x y")]
    assert run(spark, rows, threshold, least) == plain(rows, threshold, least)


def test_small_batches_against_brute_force(spark, monkeypatch):
    for name, value in {"_FLUSH_BYTES": 900, "_CHUNK": 300, "_PAIRS": 64, "_SOME_ENTRIES": 40}.items():
        monkeypatch.setattr(linededup, name, value)
    rows = some_rows(2, 120)
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("hot_word", [2, 1 << 40])
def test_frequent_words_and_large_groups(spark, monkeypatch, hot_word):
    small = {"_FLUSH_BYTES": 2000, "_CHUNK": 500, "_SOME_ENTRIES": 30, "HOT_WORD": hot_word, "MOST_SETS": 4, "BLOCK_SETS": 3, "_ASKED_LINES": 2, "_MEMBER_LINES": 3}
    for name, value in small.items():
        monkeypatch.setattr(linededup, name, value)
    rng = random.Random(8)
    # a template that very many lines share, with one to three words of their own
    rows = [(i, "\n".join("name of the " + " ".join(f"u{rng.randrange(60)}" for _ in range(rng.randint(1, 3))) + " and so on" for _ in range(3))) for i in range(60)]
    rows += [(100 + i, t) for i, t in some_rows(5, 30)]
    for threshold in (0.6, 0.8):
        assert run(spark, rows, threshold) == plain(rows, threshold)


def test_empty_table(spark):
    assert run(spark, []) == []
