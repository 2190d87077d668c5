import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError, PublishError
from tidemill.operators import apply_step
from tidemill.operators.rules import checked
from tidemill.plans.runner import Runner
from tidemill.plans.spec import parse_pipeline
from tidemill.plans.state import StateStore
from tidemill.sources import read_source, remote, write_sink
from tidemill.sources.base import Folder, publish_all
from tidemill.sources.databases import merge_statement


def test_sqlite_types_hold_all_values(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as link:
        link.execute("CREATE TABLE t (a, b, c, d)")
        link.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, i, None if i < 300 else i, None) for i in range(400)] + [(1.5, "x", 7, None)])
    found = read_source(spark, {"type": "sqlite", "database": path, "table": "t"})
    assert [f.dataType.simpleString() for f in found.schema] == ["double", "string", "bigint", "string"]
    assert found.agg(F.sum("a")).first()[0] == sum(range(400)) + 1.5
    assert found.where("b = 'x'").count() == 1 and found.where("c is not null").count() == 101


@pytest.mark.parametrize("where", ["a = 1; drop table t", "a in (select 1 union select 2)", "xp_cmdshell = 1", "pg_read_binary_file('x') is null", "lo_export(1, 'x') = 1", "a = 1 -- b"])
def test_conditions_that_are_barred(spark, tmp_path, where):
    with pytest.raises(ConfigurationError):
        read_source(spark, {"type": "sqlite", "database": str(tmp_path / "x.db"), "table": "t", "where": where})


def test_jdbc_in_parallel_and_upsert(spark):
    url = "jdbc:derby:memory:trip;create=true"
    rows = spark.range(100).select(F.col("id").alias("A"), (F.col("id") * 2).alias("B"))
    write_sink(rows, {"type": "sql", "dsn": url, "table": "T"})
    parts = {"partition_column": "A", "lower_bound": 0, "upper_bound": 100, "num_partitions": 4}
    found = read_source(spark, {"type": "sql", "dsn": url, "table": "T", "where": "B > 100", **parts})
    assert found.rdd.getNumPartitions() == 4 and found.count() == 49
    asked = read_source(spark, {"type": "sql", "dsn": url, "query": "SELECT A, B FROM T WHERE A < 10", **parts})
    assert asked.count() == 10
    with pytest.raises(ConfigurationError):
        read_source(spark, {"type": "sql", "dsn": url, "table": "T", "limit": 5, **parts})
    new = spark.createDataFrame([(5, -1), (500, -2)], "A long, B long")
    write_sink(new, {"type": "sql", "dsn": url, "table": "T", "mode": "upsert", "key_columns": "A"})
    after = {r["A"]: r["B"] for r in read_source(spark, {"type": "sql", "dsn": url, "table": "T"}).collect()}
    assert len(after) == 101 and after[5] == -1 and after[500] == -2 and after[6] == 12
    assert "ON DUPLICATE KEY UPDATE b = VALUES(b)" in merge_statement("jdbc:mysql://h/d", "t", "s", ["a", "b"], ["a"])


def test_csv_skips_by_position_and_splits(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.csv").write_text(f"note {i}\na,b\na,b\n{i},\"x, y\"\n")
    found = read_source(spark, {"type": "csv", "path": str(folder), "skip_rows": 1}).collect()
    assert sorted(map(tuple, found)) == [("0", "x, y"), ("1", "x, y"), ("a", "b"), ("a", "b")]
    (tmp_path / "l.csv").write_bytes("skip\nnäme\nmüll\n".encode("latin-1"))
    assert [r["näme"] for r in read_source(spark, {"type": "csv", "path": str(tmp_path / "l.csv"), "skip_rows": 1, "encoding": "latin-1"}).collect()] == ["müll"]
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert sorted(r["b"] for r in read_source(spark, {"type": "csv", "path": str(tmp_path / "q.csv")}).collect()) == ["two\nlines", "x"]
    (tmp_path / "big.csv").write_text("a,b\n" + "".join(f"{i},some text to fill the file\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        big = read_source(spark, {"type": "csv", "path": str(tmp_path / "big.csv")})
        assert big.rdd.getNumPartitions() > 4 and big.count() == 60_000
        skipped = read_source(spark, {"type": "csv", "path": str(tmp_path / "big.csv"), "skip_rows": 2, "has_header": False, "columns": "x, y"})
        assert skipped.count() == 59_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_outputs_are_staged_before_any_is_published(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    df = spark.range(5)
    broken = df.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        publish_all([(df, {"type": "parquet", "path": good}), (broken, {"type": "parquet", "path": bad})])
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith(".")] and not list(tmp_path.glob(".*staging"))
    publish_all([(df, {"type": "parquet", "path": good}), (df, {"type": "json", "path": bad})])
    assert spark.read.parquet(good).count() == 5 and spark.read.json(bad).count() == 5


def test_moving_files_fails_loudly(spark, tmp_path):
    (tmp_path / "x").write_text("1")
    folder = Folder(spark, str(tmp_path))

    class Refusing:
        def listStatus(self, path):
            return real.listStatus(path)

        def rename(self, old, new):
            return False

    real, folder.fs = folder.fs, Refusing()
    with pytest.raises(PublishError):
        folder.move_files(Folder(spark, str(tmp_path / "to")))


def test_state_replaces_whole_documents(spark, tmp_path):
    state = StateStore(spark, str(tmp_path / "s"))
    for i in range(3):
        state.put({"mark": i}, "marks", "p", "t")
        assert state.get("marks", "p", "t") == {"mark": i}
    state.forget("marks", "p", "t")
    assert state.get("marks", "p", "t") is None


def test_a_task_runs_out_of_time(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    task = {"id": "t", "timeout": 2, "source": {"type": "parquet", "path": str(tmp_path / "in")}, "destination": {"type": "slow"}}
    from tidemill.sources.base import SINKS

    if "slow" not in SINKS.names():

        @SINKS.register("slow")
        def slow(df):
            def wait(batches):
                import time

                time.sleep(60)
                yield from batches

            df.mapInPandas(wait, df.schema).write.format("noop").mode("overwrite").save()

    done = Runner(spark).run(parse_pipeline({"name": "p", "tasks": [task]})).tasks["t"]
    assert done.status == "failed" and "more than 2 s" in done.error and done.seconds < 40


class FakeFtp:
    files: dict = {}

    def __init__(self):
        self.closed = False

    def connect(self, host, port, timeout): ...
    def login(self, user, password):
        if password != "right":
            raise PublishError("login")

    def prot_p(self): ...
    def set_pasv(self, passive): ...
    def close(self): ...

    def retrbinary(self, command, take, block):
        data = self.files[command.split(" ", 1)[1]]
        for i in range(0, len(data), 7):
            take(data[i : i + 7])

    def storbinary(self, command, source, block):
        kind, name = command.split(" ", 1)
        data = b""
        while part := source.read(block):
            data += part
        self.files[name] = (self.files.get(name, b"") if kind == "APPE" else b"") + data

    def rename(self, old, new):
        self.files[new] = self.files.pop(old)


def test_ftp_both_ways(spark, monkeypatch):
    monkeypatch.setattr(remote.ftplib, "FTP", FakeFtp)
    FakeFtp.files.clear()
    at = {"type": "ftp", "host": "h", "password": "right", "tls": False, "remote_path": "/x/rows.csv"}
    FakeFtp.files["/x/rows.csv.uploading"] = b"what a failed try left"
    write_sink(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), at)
    assert set(FakeFtp.files) == {"/x/rows.csv"} and FakeFtp.files["/x/rows.csv"].startswith(b"id,name\n")
    assert sorted(r["name"] for r in read_source(spark, at).collect()) == ["a", "b"]
    with pytest.raises(PublishError):
        read_source(spark, at | {"password": "wrong"})


class FakeSftp:
    files: dict = {}

    def open(self, name, mode):
        import io

        outer = self

        class Out(io.BytesIO):
            def close(self):
                if mode != "rb":
                    outer.files[name] = self.getvalue()
                super().close()

        if mode == "rb":
            return io.BytesIO(self.files[name])
        out = Out()
        if mode == "ab":
            out.write(self.files.get(name, b""))
        return out

    def posix_rename(self, old, new):
        self.files[new] = self.files.pop(old)

    def remove(self, name):
        del self.files[name]


def test_sftp_both_ways(spark, monkeypatch):
    class Client:
        def open_sftp(self):
            return FakeSftp()

        def close(self): ...

    monkeypatch.setattr(remote, "_sftp", lambda *a: Client())
    FakeSftp.files.clear()
    at = {"type": "sftp", "host": "h", "user": "u", "remote_path": "/x/rows.jsonl"}
    FakeSftp.files["/x/rows.jsonl.uploading"] = b"what a failed try left"
    write_sink(spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"), at)
    assert set(FakeSftp.files) == {"/x/rows.jsonl"} and b"failed" not in FakeSftp.files["/x/rows.jsonl"]
    assert sorted(r["id"] for r in read_source(spark, at | {"delete_after": True}).collect()) == [1, 2] and not FakeSftp.files


def test_limits_that_are_counted_first(spark, monkeypatch):
    from tidemill.operators import relational

    monkeypatch.setattr(relational, "MOST_LISTED", 3)
    df = spark.createDataFrame([(1, i) for i in range(4)], "k long, v long")
    with pytest.raises(ConfigurationError):
        apply_step(df, {"type": "aggregate", "group_by": "k", "aggregations": {"v": "list"}})


def test_unique_with_one_key_for_most_rows(spark):
    rows = [(i, None if i % 2 else 1 if i % 5 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "o long, k long")
    bad = {r["o"] for r in checked(df, [{"type": "unique", "field": "k", "order_by": "o"}]).collect() if r["_violations"]}
    seen, want = set(), set()
    for o, k in rows:
        want |= {o} if k in seen else set()
        seen.add(k)
    assert bad == want
