from pyspark.sql import functions as F

from tidemill.llm import exactdedup


def rows_and_docs(spark):
    rows = [(5, "Ab"), (1, "aB"), (2, None), (3, ""), (9, "É"), (10, "é"), (None, "ab"), (None, "solo"), (7, "x" * 100_000), (8, "x" * 100_000), (4, "cd"), (4, "cd"), (11, "ef")]
    return rows, spark.createDataFrame([(d, t, "z", 0) for d, t in rows], "doc_id long, text string, _text string, kept int")


def plain(rows, keep):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for d, t in rows:
        group = [e for e, u in rows if fold(u) == fold(t)]
        ids = [e for e in group if e is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        out.append((d, best, len(group), d == best))
    return sorted(map(repr, out))


def test_against_brute_force_with_colliding_hashes(spark):
    rows, docs = rows_and_docs(spark)
    weak = lambda text: [F.length(text).cast("long"), F.lit(0).cast("long")]
    for keep in ("min", "max"):
        for hashes in (exactdedup.content_hash, weak):
            found = exactdedup.exact_duplicates(docs, keep=keep, hashes=hashes).collect()
            assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])) for r in found) == plain(rows, keep)


def test_dropping_keeps_all_columns(spark):
    _, docs = rows_and_docs(spark)
    kept = exactdedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 9, 10, None, None, 7, 4, 4, 11]))


def test_main_path_is_native(spark):
    _, docs = rows_and_docs(spark)
    plan = exactdedup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    assert exactdedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
