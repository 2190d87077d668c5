import corpus_pipeline
from tests.llm.test_linededup import plain as plain_lines
from tidemill.llm import simhash
from tidemill.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns
        assert docs.count() > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality"][1].collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    before, after = seen["line dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(repr((r["doc_id"], r["text"])) for r in after.collect()) == plain_lines(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = seen["simhash near-dedup"]
    groups = {r["group_id"] for r in simhash.near_duplicate_groups(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(groups)
    before, after = seen["mixture"]
    assert after.count() < before.count()
    before, after = seen["sentencepiece"]
    assert after.count() == before.count() and after.where("round_trip").count() == before.count()


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    names = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    odd = [dict.fromkeys(names), rows[3], rows[3], rows[4] | {"text": None}, rows[5] | {"text": ""}, rows[6] | {"doc_id": 10**9, "source": None, "lang": None, "text": "word and more. " * 60_000}]
    more = spark.createDataFrame([*rows, *odd], docs.schema).selectExpr("*", "1 as _quality", "'x' as _id", "2 as shard", "'y' as _gone", "3 as node")
    for start in (more, more.where("false")):
        found = start
        for name, stage in corpus_pipeline.STAGES:
            found = materialize(stage(spark, found, SF), "test-odd")
            if name != "sentencepiece":
                assert found.columns == start.columns, name
        assert (found.count() > 0) == (not start.isEmpty())


def test_mixture_stage_matches_a_plain_version(spark):
    """Raking with dictionaries, then each document by the MD5 of its id."""
    import hashlib
    from collections import defaultdict

    from tidemill.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.selectExpr("*", f"{queries.TOPIC} AS topic").collect()]
    words = {r["doc_id"]: r["text"].count(" ") + 1 for r in rows}
    cells = defaultdict(float)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += words[r["doc_id"]]
    weight = dict.fromkeys(cells, 1.0)
    shares = [queries.SOURCE_SHARES, queries.LANG_SHARES, queries.TOPIC_SHARES]
    had = [defaultdict(float) for _ in shares]
    for k, n in cells.items():
        for h, v in zip(had, k):
            h[v] += n
    for _ in range(queries.MIX_ROUNDS):
        for i, share in enumerate(shares):
            known = [v for v in had[i] if v in share]
            whole, parts = sum(had[i][v] for v in known), sum(share[v] for v in known)
            now = defaultdict(float)
            for k, n in cells.items():
                now[k[i]] += n * weight[k]
            for k in cells:
                if k[i] in share and now[k[i]]:
                    weight[k] *= share[k[i]] / parts * whole / now[k[i]]
    budget, sure = corpus_pipeline.MIXTURE_SHARE * sum(cells.values()), set()
    while True:
        factor = (budget - sum(cells[k] for k in sure)) / sum(cells[k] * weight[k] for k in cells if k not in sure)
        more = {k for k in cells if k not in sure and factor * weight[k] >= 1}
        if not more:
            break
        sure |= more
    chance = {k: 1.0 if k in sure else factor * weight[k] for k in cells}
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32  # noqa: E731, S324
    want = sorted(r["doc_id"] for r in rows if draw(r["doc_id"]) < chance[r["source"], r["lang"], r["topic"]])
    assert sorted(r["doc_id"] for r in corpus_pipeline.mixture_stage(spark, docs, SF).collect()) == want


def test_token_stage_matches_the_library(spark):
    import hashlib

    from sentencepiece import SentencePieceProcessor

    from tidemill.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = SentencePieceProcessor(model_file=queries.PIECES)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.token_stage(spark, docs, SF).collect()}
    for r in docs.collect():
        ids = model.encode(r["text"])
        assert found[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
