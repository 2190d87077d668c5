import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path int, _group string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def climb(digests, fanout):
    """The top and, for each node, the pairs (siblings before, siblings after) up to it."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for path, p in zip(paths, at):
            run = runs[p // fanout]
            path.append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        at, level = [p // fanout for p in at], [digest(*run) for run in runs]
    return (level or [None])[0], paths


def plain(rows, fanout=3):
    """One tuple a row: id, leaf, subroot, root, digest of the siblings, root folded from the tampered leaf, and whether they are equal."""
    groups = {}
    for r in rows:
        groups.setdefault("" if r["source"] is None else "=" + r["source"], []).append(r)
    names = sorted(groups, key=str.encode)
    made = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        made[g] = (own, *climb([leaf_of(r) for r in own], fanout))
    root, above = climb([made[g][1] for g in names], fanout)
    out = []
    for g, up in zip(names, above):
        own, subroot, paths = made[g]
        for r, path in zip(own, paths):
            folded = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                folded = leaf_of(r | {"text": r["text"] and r["text"].replace("\n", "")})
            for before, after in path + up:
                folded = digest(before, folded, after)
            out.append((r["doc_id"], leaf_of(r), subroot, root, digest(*(x for pair in path + up for x in pair)), folded, folded == root))
    return sorted(out, key=repr)


def found(spark, rows, monkeypatch):
    from tidemill.llm import queries

    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "y") for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "_table", lambda *_: df)
    return sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, "").collect()), key=repr)


def row(i, source, text="a\nb", lang="en"):
    return {"doc_id": i, "source": source, "text": text, "lang": lang, "n_chars": None if text is None else len(text)}


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 28, 9, 10], [81, 1, 1, 82], [200, 3]])
def test_equals_a_plain_tree(spark, monkeypatch, sizes):
    rows = [row(100 * g + i, f"s{g}", f"text {i}\nmore " * (i % 3)) for g, n in enumerate(sizes) for i in range(n)]
    assert found(spark, rows, monkeypatch) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [row(i, None) for i in range(7)] + [row(i, "") for i in range(5)] + [row(i, "\U0001f600") for i in range(4)] + [row(i, "￮") for i in range(4)]
    rows += [row(None, "s"), row(None, "s"), row(3, "s", None), row(3, "s", ""), row(4, "s", "\n" * 50_000, None), row(4, "s", "\n" * 50_000, None), row(-5, "s", "é\n")]
    assert found(spark, rows, monkeypatch) == plain(rows)


def test_empty_table(spark, monkeypatch):
    assert found(spark, [], monkeypatch) == []


def test_other_columns_and_fanout(spark):
    docs = spark.createDataFrame([(i, f"g{i % 2}", "t" * i) for i in range(23)], "key int, kind string, body string")
    got = merkle.manifest(docs, ["key", "body"], "key", "kind", fanout=4)
    folded = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(folded) == 23 and len({r["root"] for r in folded}) == 1 and all(r["folded"] == r["root"] for r in folded)
    assert len({r["subroot"] for r in folded}) == 2
