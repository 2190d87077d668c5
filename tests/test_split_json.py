import json
import random

import pytest

from tidemill.errors import TidemillError
from tidemill.sources import split_json
from tidemill.sources.base import read_source


class Held:
    def __init__(self, data):
        self.data = data

    def read(self, first, end):
        return self.data[first:end]


def cut(data, size, root=None, strict=True):
    """What the two passes give without Spark."""
    file, n = Held(data), len(data)
    start, around = split_json.array_start(file, n, root)
    level, inside, depth, alive, out, tasks = around + 1, False, 0, True, [], 0
    for a in range(0, n, size):
        b = min(a + size, n)
        if alive and b > start:
            got = [json.loads(x) for x in split_json.elements(file, n, a, b, inside, depth, start, level, strict)]
            out += got
            tasks += bool(got)
        ends, change, lowest = split_json.survey(file, a, b)[inside]
        if a > start and depth + lowest < level:
            alive = False
        inside, depth = ends, depth + change
    assert (inside, depth) == (False, 0)
    return out, tasks


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", "é", "a", "\n", "\\\\\"", " "]) for _ in range(rng.randrange(12)))
    if kind < 6:
        return rng.choice([None, True, 0, -1.5, 10**12])
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_any_size_give_all_elements(seed, indent, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(split_json, "_BLOCK", 61)
    items = [value(rng) for _ in range(40)]
    docs = [(items, None), ({"meta": {"data": [1, {"x": "]"}]}, "a": {"data": items, "more": [[1], {"y": [2]}]}, "data": [9, 9]}, "a.data"), ([], None), ([[]], None), ([5], None)]
    for doc, root in docs:
        data = json.dumps(doc, ensure_ascii=bool(seed % 2), indent=indent).encode()
        want = doc if root is None else items
        for size in (5, 17, 100, 1 << 20):
            found, tasks = cut(data, size, root)
            assert found == want, (root, size)
            assert size > 100 or len(want) < 30 or tasks > 3


@pytest.mark.parametrize("bad", [b'[{"a": 1},, {"a": 2}]', b'[{"a": 1} {"a": 2}]', b'[{"a": 1}, ]', b'[{"a": "x\ny"}]', b'[{"a": 1} 5]'])
def test_malformed_elements(bad):
    with pytest.raises(TidemillError):
        cut(bad, 1 << 20)
    with pytest.raises(TidemillError):
        cut(bad, 4)
    assert all(x.get("a") in (1, 2, "x y") for x in cut(bad, 1 << 20, strict=False)[0])


def test_source_over_spark(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"id": i, "text": "".join(rng.choice('a"\\[]{},é') for _ in range(20)), "n": {"x": [i, i + 1]}} for i in range(2000)]
    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"head": {"n": len(rows)}, "rows": rows, "tail": [{"id": -1}]}, ensure_ascii=False))
    for size in (3000, None):
        df = read_source(spark, {"type": "json", "path": str(path), "root": "rows", **({"range_bytes": size} if size else {})})
        assert sorted((r["id"], r["text"], r["n"]["x"]) for r in df.collect()) == [(r["id"], r["text"], r["n"]["x"]) for r in rows]
    path.write_text(json.dumps(rows)[:-40])
    with pytest.raises(TidemillError):
        read_source(spark, {"type": "json", "path": str(path), "range_bytes": 3000})
    path.write_text(json.dumps([1, "two", None, [3]] * 500))
    assert read_source(spark, {"type": "json", "path": str(path), "range_bytes": 1000}).count() == 2000
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.json").write_text(json.dumps(rows))
    (tmp_path / "two" / "b.json").write_text(json.dumps(rows[0]))
    assert read_source(spark, {"type": "json", "path": str(tmp_path / "two"), "range_bytes": 20_000}).count() == 2001


def test_many_ranges_share_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(split_json, "TASKS_A_CORE", 2)
    want, files = [], []
    for k in range(3):
        rows = [{"id": f"{k}-{i}", "t": "x[{,\\" * rng.randrange(60)} for i in range(2000)]
        path = tmp_path / f"a{k}.json"
        path.write_text(json.dumps(rows))
        files.append((str(path), path.stat().st_size))
        want += rows
    size = 1 << 10
    path = split_json.read_documents(spark, files, None, True, size, str(tmp_path))
    parts = [p for p in (tmp_path / "documents").rglob("part-*") if p.suffix == ".txt"]
    ranges = sum(-(-n // size) for _, n in files)
    assert ranges > 300 and len(parts) <= 2 * 2 * spark.sparkContext.defaultParallelism + 3
    got = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    key = lambda r: r["id"]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert split_json.ranges_of_a_task(20, 1 << 18, 12) == 1 and split_json.ranges_of_a_task(10**6, 1 << 18, 12) == 128
