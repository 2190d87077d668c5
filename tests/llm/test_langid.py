import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import langid


def plain_model(symbols_list, order, vocabulary):
    """Interpolated Kneser-Ney with dictionaries."""
    counts = {order: Counter()}
    for s in symbols_list:
        s = (0,) * (order - 1) + tuple(s)
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables[k] = (c, d, total, kinds)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / vocabulary
        c, d, total, kinds = tables[k]
        h = gram[:-1]
        return lower if not total[h] else max(c[gram] - d, 0) / total[h] + d * kinds[h] / total[h] * lower

    return p


def test_log_probabilities_match_dictionaries():
    rng = random.Random(1)
    order, alphabet = 3, "abcd"
    corpora = [["".join(rng.choices("abcd ", (5, 3, 1, 1, 2), k=60)) for _ in range(5)], ["".join(rng.choices("abc ", (1, 1, 6, 2), k=60)) for _ in range(5)]]
    tables = []
    for texts in corpora:
        symbols, kept = langid._symbols(texts, alphabet, order)
        tables.append(np.unique(langid._grams(symbols, order)[langid._positions(kept, order)], return_counts=True))
    codes = np.unique(np.concatenate([t[0] for t in tables]))
    counts = np.zeros((len(codes), 2))
    for k, (c, n) in enumerate(tables):
        counts[np.searchsorted(codes, c), k] = n
    models = langid.GroupedModels([langid.LanguageModels(["x", "y"], alphabet, order, codes, counts)])

    def ids(text):
        out = [alphabet.index(c) + 1 if c in alphabet else langid._OTHER if c.isalpha() else 0 for c in text.lower()]
        return [v for i, v in enumerate(out) if v or (i and out[i - 1])]

    tests = ["abca dd", "  zz a", "DCBA", "a", "bbb ccc, aaa", "", "1 2"]
    bits, letters = models.cross_entropies(tests)
    assert letters.tolist() == [True] * 5 + [False] * 2
    for k, texts in enumerate(corpora):
        p = plain_model([ids(t) for t in texts], order, len(alphabet) + 2)
        for t, b in zip(tests[:5], bits[:5, k]):
            s = [0, 0, *ids(t)]
            want = -sum(math.log2(p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) / (len(s) - 2)
            assert abs(b - want) < 1e-5
        assert abs(sum(p((1, 2, c)) for c in [0, 1, 2, 3, 4, 255]) - 1) < 1e-9


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, None, "en"), (9001, None, "en"), (9002, "", None), (9003, " 12 .", "de"), (9004, "x", None), (9004, "x", None)], docs.schema)
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    labelled = docs.where("crc32(cast(doc_id as string)) % 4 <> 2").select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    rows = langid.identify(docs, F.col("text"), ["doc_id", "lang"], langid.train(labelled, 60)).collect()
    assert len(rows) == docs.count()
    plain = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 9000]
    assert sum(r["lang_pred"] == r["lang"] for r in plain) >= 0.97 * len(plain)
    und = [(r["doc_id"], r["score"], r["rejected"]) for r in rows if r["lang_pred"] == "und"]
    assert sorted(map(repr, und)) == sorted(map(repr, [(i, 0.0, True) for i in (None, 9001, 9002, 9003)]))
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_groups_of_languages_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    labelled = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))

    def found():
        rows = langid.identify(docs, F.col("text"), ["doc_id"], langid.train(labelled, 40)).collect()
        return sorted((r["doc_id"], r["lang_pred"], r["rejected"], round(r["score"], 5), r["bits_per_char"] and round(r["bits_per_char"], 5)) for r in rows)

    together = found()
    monkeypatch.setattr(langid, "GROUP_LANGUAGES", 1)
    assert found() == together


def test_two_thousand_languages(spark):
    rng = random.Random(3)
    # each language has two letters of its own among a common alphabet of many
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    rows = [(i * 4 + j, "".join(rng.choice([letters[2 * i], letters[2 * i + 1], "a", "e"]) for _ in range(60)), f"l{i:04d}") for i in range(2000) for j in range(4)]
    labelled = spark.createDataFrame(rows, "_key long, _text string, _lang string").repartition(4)
    trained = langid.train(labelled, docs_per_lang=100)
    assert len(trained["limits"]) == len(trained["models"].value.languages) == 2000 and len(trained["models"].value.parts) == 125
    asked = spark.createDataFrame([(k, t, lang) for k, t, lang in rows[::80]], "_key long, _text string, _lang string")
    found = langid.identify(asked, F.col("_text"), ["_lang"], trained).collect()
    assert sum(r["lang_pred"] == r["_lang"] for r in found) >= 0.95 * len(found)


def test_empty_table(spark):
    none = spark.createDataFrame([], "_key long, _text string, _lang string")
    trained = langid.train(none)
    assert langid.identify(none, F.col("_text"), ["_key"], trained).collect() == []
    some = spark.createDataFrame([(1, "abc")], "_key long, _text string")
    assert langid.identify(some, F.col("_text"), ["_key"], trained).collect()[0]["lang_pred"] == "und"
