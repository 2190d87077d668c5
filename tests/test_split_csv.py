import csv
import io
import json
import random

import pytest

from tidemill.errors import ConfigurationError
from tidemill.sources import split_csv
from tidemill.sources.base import read_source

NAMES = ["a", "b", "c"]


def read(path, range_bytes, names=NAMES, **options):
    how = {"files": [[str(p), p.stat().st_size] for p in ([path] if not isinstance(path, list) else path)], "names": names, "delimiter": ",", "quote": '"', "encoding": "utf-8", "skip_rows": 0, "header": True, "range": range_bytes} | options
    reader = split_csv.SplitCsvReader({"how": json.dumps(how)})
    rows, tasks = [], 0
    for p in reader.partitions():
        got = [r for batch in reader.read(p) for r in batch.to_pylist()]
        tasks += bool(got)
        rows += got
    return [list(r.values()) for r in rows], tasks


def plain(text, n=3, skip=0):
    """Python's own reader over the whole text."""
    body = "".join(text.splitlines(keepends=True)[skip:]) if skip else text
    rows = [r for r in csv.reader(io.StringIO(body, newline="")) if r][1:]
    return [(r + [None] * n)[:n] for r in rows]


def cell(rng):
    kind = rng.randrange(9)
    if kind == 0:
        return ""
    if kind == 1:
        return '5" pipe'
    if kind == 2:
        return '"' + "".join(rng.choice(['""', ",", "\n", "\r\n", "x", "é ", '"",""', '""\n'] if True else []) for _ in range(rng.randrange(12))) + '"'
    if kind == 3:
        return '"' + "line\n" * rng.randrange(30) + '"'
    return "".join(rng.choice("abc é") for _ in range(rng.randrange(9)))


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_ranges_of_any_size_equal_one_reader(tmp_path, seed, line, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(split_csv, "LOOK_BACK", 16)
    monkeypatch.setattr(split_csv, "_STEP", 32)
    text = "a,b,c" + line + line.join(",".join(cell(rng) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(60)) + rng.choice(["", line])
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    want = plain(text)
    for size in (7, 40, 333, 1 << 20):
        got, tasks = read(path, size)
        assert got == want, size
        assert tasks > 5 or size > 300


def test_files_without_quotes_take_line_ends(tmp_path, monkeypatch):
    monkeypatch.setattr(split_csv, "LOOK_BACK", 20)
    monkeypatch.setattr(split_csv, "MOST_BACK", 80)
    path = tmp_path / "t.csv"
    text = "a,b,c\n" + "".join(f"{i},x,{i * i}\n" for i in range(500))
    path.write_text(text)
    got, tasks = read(path, 300)
    assert got == plain(text) and tasks > 15


def test_cells_longer_than_the_look_back_fail_loudly(tmp_path, monkeypatch):
    monkeypatch.setattr(split_csv, "LOOK_BACK", 20)
    monkeypatch.setattr(split_csv, "MOST_BACK", 80)
    path = tmp_path / "t.csv"
    text = 'a,b,c\n1,"' + "no quote here\n" * 100 + '",3\n' + "4,5,6\n" * 50
    path.write_text(text)
    with pytest.raises(ConfigurationError, match="multiline"):
        read(path, 300)
    assert read(path, 1 << 20)[0] == plain(text)
    # with quotes nearby the same cell is no trouble
    text = text.replace("no quote here", 'a ""quote"" here')
    path.write_text(text)
    assert read(path, 300)[0] == plain(text)


def test_skipped_lines_marks_and_several_files(tmp_path):
    text = "﻿# made by\n# someone\n\na,b,c\n" + "".join(f'{i},"x\ny",\n' for i in range(40))
    first, second, empty = tmp_path / "1.csv", tmp_path / "2.csv", tmp_path / "3.csv"
    first.write_text(text)
    second.write_text(text)
    empty.write_text("")
    want = [[str(i), "x\ny", ""] for i in range(40)]
    for size in (30, 1 << 20):
        got, _ = read([first, second, empty], size, skip_rows=2)
        assert got == want * 2
    assert read(first, 10, skip_rows=500)[0] == []


def test_bad_bytes_become_replacement_characters(tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a,b,c\n1,\xff,3\n")
    assert read(path, 1 << 20)[0] == [["1", "�", "3"]]


def test_source_over_spark_equals_duckdb(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    rows = [[str(i), rng.choice(["", 'say "so"', "two\nlines", "a,b", "x" * 50]), f"{i % 7}"] for i in range(3000)]
    path = tmp_path / "t.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([NAMES, *rows])
    df = read_source(spark, {"type": "csv", "path": str(path), "range_bytes": 4000})
    assert df.rdd.getNumPartitions() > 10
    want = duckdb.sql(f"SELECT nullif(a, ''), nullif(b, ''), nullif(c, '') FROM read_csv('{path}', header=true, all_varchar=true, quote='\"', escape='\"') ORDER BY a::INT").fetchall()
    assert [tuple(r) for r in df.collect()] == want
    assert [tuple(r) for r in read_source(spark, {"type": "csv", "path": str(path)}).collect()] == want
    picked = df.where("c = '3'").select("a")
    assert picked.count() == sum(r[2] == "3" for r in rows)


def test_skip_rows_beyond_the_first_range(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# comment\n" * 60 + "a,b,c\n" + "".join(f"{i},x,y\n" for i in range(50)))
    df = read_source(spark, {"type": "csv", "path": str(path), "skip_rows": 60, "range_bytes": 200})
    assert df.columns == NAMES and df.count() == 50
