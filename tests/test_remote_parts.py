import io
import json

import pytest

from tests.ftp_server import FtpServer
from tidemill.plans.runner import Runner
from tidemill.plans.spec import parse_pipeline
from tidemill.sources import remote, remote_parts
from tidemill.sources.base import read_source, write_sink


@pytest.mark.parametrize("size", [1, 3, 7, 50, 1000])
@pytest.mark.parametrize("block", [1, 4, 1000])
def test_lines_of_ranges(size, block):
    text = b"first\n\nsecond line\n\xc3\xa9\n" + b"x" * 40 + b"\nlast without end"

    class Held:
        def read(self, first, end):
            return text[first:end]

    for body in (text, text + b"\n", b"\n", b""):
        text = body
        got = [line for a in range(0, len(body), size) for line in remote_parts.lines(Held(), len(body), a, min(a + size, len(body)), block)]
        assert got == ((body[:-1] if body.endswith(b"\n") else body).split(b"\n") if body else [])


def test_one_large_csv_is_read_by_several_tasks(spark):
    body = "id,text\n" + "".join(f'{i},"line one\nline ""two"" of {i}"\n' for i in range(2000))
    with FtpServer() as server:
        server.files["/in/rows.csv"] = body.encode()
        df = read_source(spark, server.login | {"remote_path": "/in/rows.csv", "range_bytes": 8000})
        rows = df.collect()
        assert df.rdd.getNumPartitions() > 5
        assert [(r["id"], r["text"]) for r in rows] == [(str(i), f'line one\nline "two" of {i}') for i in range(2000)]
        assert len({offset // 8000 for _, offset in server.reads}) > 5  # the ranges were asked for, not the whole file each time
        # a small file comes in one piece
        assert read_source(spark, server.login | {"remote_path": "/in/rows.csv"}).count() == 2000


def test_one_large_jsonl_is_fetched_by_several_tasks(spark):
    with FtpServer() as server:
        server.files["/in/rows.jsonl"] = "".join(json.dumps({"id": i, "name": f"é{i}"}, ensure_ascii=False) + "\n" for i in range(3000)).encode()
        df = read_source(spark, server.login | {"remote_path": "/in/rows.jsonl", "range_bytes": 9000})
        assert sorted((r["id"], r["name"]) for r in df.collect()) == [(i, f"é{i}") for i in range(3000)]
        assert len({offset // 9000 for _, offset in server.reads}) > 5


@pytest.mark.parametrize("kind", ["csv", "jsonl"])
def test_tasks_send_parts(spark, kind):
    df = spark.range(100).selectExpr("id", "concat('n', id, ',\"x') AS name").repartition(4, "id")
    with FtpServer() as server:
        write_sink(df, server.login | {"remote_path": f"/out/rows.{kind}", "parts": True})
        assert sorted(server.files) == [f"/out/rows-{i:05d}.{kind}" for i in range(4)]
        found = []
        for name, data in server.files.items():
            if kind == "csv":
                assert data.startswith(b"id,name\n")
                found += [r["name"] for r in read_source(spark, server.login | {"remote_path": name}).collect()]
            else:
                found += [json.loads(line)["name"] for line in data.splitlines()]
        assert sorted(found) == sorted(f'n{i},"x' for i in range(100))


def test_a_failed_job_leaves_no_parts(spark):
    df = spark.range(100).repartition(4, "id").selectExpr("id", "CASE WHEN id = 77 THEN raise_error('bad row') ELSE id END AS name")
    with FtpServer() as server:
        server.files["/out/rows-00000.csv"] = b"before"
        with pytest.raises(Exception):  # noqa: B017
            write_sink(df, server.login | {"remote_path": "/out/rows.csv", "parts": True})
        assert server.files["/out/rows-00000.csv"] == b"before"
        assert [n for n in server.files if not n.endswith(".uploading")] == ["/out/rows-00000.csv"]


def test_parts_of_no_rows(spark):
    with FtpServer() as server:
        write_sink(spark.createDataFrame([], "a string, b long"), server.login | {"remote_path": "/out/rows.csv", "parts": True})
        assert list(server.files.values()) in ([b"a,b\n"], [])


class FakeSftp:
    files: dict = {}

    def open_sftp(self):
        return self

    def close(self): ...

    def stat(self, path):
        return type("S", (), {"st_size": len(self.files[path])})

    def open(self, path, mode):
        outer = self

        class Out(io.BytesIO):
            def close(self):
                if mode == "wb":
                    outer.files[path] = self.getvalue()
                super().close()

        return io.BytesIO(self.files[path]) if mode == "rb" else Out()

    def posix_rename(self, old, new):
        self.files[new] = self.files.pop(old)

    def remove(self, path):
        del self.files[path]


def test_sftp_ranges_and_parts(monkeypatch):
    """The reader and writer as Spark calls them, over a stand-in for the client."""
    monkeypatch.setattr(remote, "_sftp", lambda *a: FakeSftp())
    FakeSftp.files = {"/x/rows.jsonl": b'{"a": 1}\n' * 500}
    options = {"how": json.dumps({"path": "/x/rows.jsonl", "size": 4500, "range": 1000, "encoding": "utf-8"}), "secret_login": json.dumps({"kind": "sftp", "given": []})}
    reader = remote_parts.RemoteLinesReader(options)
    assert len(reader.partitions()) == 5 and sum(len(list(reader.read(p))) for p in reader.partitions()) == 500
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda s: 3, "taskAttemptId": lambda s: 9})())
    writer = remote_parts.RemotePartsWriter(options | {"how": json.dumps({"path": "/x/out.csv", "head": "a\n", "run": "r"})})
    sent = writer.write(iter([("1",), ("2",)]))
    assert (sent.rows, FakeSftp.files["/x/out-00003.csv.r-9.uploading"]) == (2, b"a\n1\n2\n")
    writer.commit([sent, None])
    assert FakeSftp.files["/x/out-00003.csv"] == b"a\n1\n2\n"
    writer.abort([writer.write(iter([("1",)])), None])
    assert set(FakeSftp.files) == {"/x/rows.jsonl", "/x/out-00003.csv"}


def test_delete_after_waits_for_the_publication(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(remote, "_sftp", lambda *a: FakeSftp())
    source = {"type": "sftp", "host": "h", "user": "u", "remote_path": "/x/rows.jsonl", "delete_after": True}
    for broken in (True, False):
        FakeSftp.files = {"/x/rows.jsonl": b'{"a": 1}\n{"a": 2}\n'}
        steps = [{"type": "no_such_step"}] if broken else []
        spec = {"name": "p", "tasks": [{"id": "t", "source": source, "transformations": steps, "destination": {"type": "parquet", "path": str(tmp_path / "t")}}]}
        try:
            Runner(spark).run(parse_pipeline(spec), dry_run=False)
        except Exception as e:
            assert broken, e
        assert bool(FakeSftp.files) == broken
    FakeSftp.files = {"/x/rows.jsonl": b'{"a": 1}\n'}
    Runner(spark).run(parse_pipeline(spec), dry_run=True)
    assert FakeSftp.files
