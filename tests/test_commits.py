"""Publishing is killed before every step that touches the file system; recovery finds old or new data, never a part."""

import os

import pytest

from tidemill.errors import TidemillError
from tidemill.plans.runner import Runner
from tidemill.plans.spec import parse_pipeline
from tidemill.sources import base, commits
from tidemill.sources.base import publish_all, read_source, write_sink


class Killed(BaseException):
    """The driver ends here."""


@pytest.fixture
def killer(monkeypatch):
    """Arms a kill before the n-th step from now on; counts the steps."""
    state = {"left": None, "steps": 0}

    def stepped(original):
        def run(self, *args):
            if state["left"] is not None:
                state["steps"] += 1
                if state["steps"] == state["left"]:
                    raise Killed
            return original(self, *args)

        return run

    for name in ("rename", "delete", "move_files"):
        monkeypatch.setattr(base.Folder, name, stepped(getattr(base.Folder, name)))
    monkeypatch.setattr(commits, "_save", stepped(commits._save))

    def arm(at):
        state.update(left=at, steps=0)

    arm.steps = lambda: state["steps"]
    return arm


def rows(spark, path):
    return sorted(r["v"] for r in read_source(spark, {"type": "parquet", "path": path}).collect()) if os.path.exists(path) else None


def leftovers(folder):
    return sorted(n for n in os.listdir(folder) if n.startswith(".") and not n.endswith(".crc"))


@pytest.mark.parametrize("mode", ["overwrite", "append"])
@pytest.mark.parametrize("first", [True, False])
def test_one_target(spark, tmp_path, killer, mode, first):
    """``first``: the target doesn't exist before."""
    kind = "csv" if mode == "append" else "parquet"
    old, new = spark.createDataFrame([("a",), ("b",)], "v string"), spark.createDataFrame([("c",), ("d",), ("e",)], "v string").repartition(3)
    at, outcomes = 0, set()
    while True:
        at += 1
        top = tmp_path / f"{at}"
        target = {"type": kind, "path": str(top / "t"), "mode": mode}
        if first:
            top.mkdir()
        else:
            write_sink(old, target)
        killer(at)
        try:
            write_sink(new, target)
            killer(None)
            ended = True
        except Killed:
            killer(None)
            ended = False
        commits.recover(spark, target["path"])
        found = sorted(r["v"] for r in read_source(spark, {"type": kind, "path": target["path"]}).collect()) if os.path.exists(target["path"]) else None
        before = None if first else ["a", "b"]
        after = ["c", "d", "e"] if first or mode == "overwrite" else ["a", "b", "c", "d", "e"]
        assert found in (before, after), at
        outcomes.add(found == after)
        notes = [n for n in leftovers(top) if n.endswith((".commit", ".group"))]
        assert not notes
        # the next publication works, whatever was left
        write_sink(new, {"type": kind, "path": target["path"], "mode": "overwrite"})
        assert sorted(r["v"] for r in read_source(spark, {"type": kind, "path": target["path"]}).collect()) == ["c", "d", "e"]
        if ended:
            break
    assert outcomes == {True, False} and at > 3


def test_two_targets_come_together(spark, tmp_path, killer):
    one, two = spark.createDataFrame([("new",)], "v string"), spark.createDataFrame([("bad",)], "v string")
    old = spark.createDataFrame([("old",)], "v string")
    at, outcomes = 0, set()
    while True:
        at += 1
        main, rejects = (str(tmp_path / f"{at}" / n) for n in ("main", "rejects"))
        for path in (main, rejects):
            write_sink(old, {"type": "parquet", "path": path})
        killer(at)
        try:
            publish_all([(two, {"type": "parquet", "path": rejects}), (one, {"type": "parquet", "path": main})])
            killer(None)
            ended = True
        except Killed:
            killer(None)
            ended = False
        # whichever target is looked at first brings the other along
        for path in (main, rejects) if at % 2 else (rejects, main):
            commits.recover(spark, path)
        found = rows(spark, main), rows(spark, rejects)
        assert found in ((["old"], ["old"]), (["new"], ["bad"])), at
        outcomes.add(str(found))
        assert not [n for n in leftovers(tmp_path / f"{at}") if n.endswith((".commit", ".group"))]
        if ended:
            break
    assert len(outcomes) == 2 and at > 8


def test_reading_finds_a_target_that_a_crash_has_moved_away(spark, tmp_path, killer):
    target = {"type": "parquet", "path": str(tmp_path / "t")}
    write_sink(spark.createDataFrame([("old",)], "v string"), target)
    for at in range(1, 6):
        killer(at)
        try:
            write_sink(spark.createDataFrame([("new",)], "v string"), target)
        except Killed:
            pass
        killer(None)
        assert [r["v"] for r in read_source(spark, target).collect()] in (["old"], ["new"])


def test_sinks_that_cannot_be_staged_come_before_what_is_staged(spark, tmp_path):
    """A database that refuses the rows leaves the rejects unpublished."""
    import sqlite3

    db = str(tmp_path / "x.db")
    with sqlite3.connect(db) as link:
        link.execute("CREATE TABLE t (other TEXT)")
    rejects = str(tmp_path / "rejects")
    df = spark.createDataFrame([("a",)], "v string")
    with pytest.raises(Exception):  # noqa: B017
        publish_all([(df, {"type": "parquet", "path": rejects}), (df, {"type": "sqlite", "database": db, "table": "t"})])
    assert not os.path.exists(rejects) and not leftovers(tmp_path)


def test_runner_recovers_its_targets_first(spark, tmp_path, killer):
    target = str(tmp_path / "t")
    write_sink(spark.createDataFrame([("old",)], "v string"), {"type": "parquet", "path": target})
    killer(4)
    with pytest.raises(Killed):
        write_sink(spark.createDataFrame([("new",)], "v string"), {"type": "parquet", "path": target})
    killer(None)
    assert not os.path.exists(target)
    spec = parse_pipeline({"name": "p", "tasks": [{"id": "a", "source": {"type": "inline", "records": [{"v": "x"}]}, "destination": {"type": "parquet", "path": target, "mode": "error_if_exists"}}]})
    result = Runner(spark).run(spec)
    assert result.status == "failed" and "exists" in result.tasks["a"].error  # it found the new data
    assert rows(spark, target) == ["new"]
    assert issubclass(commits.PublishError, TidemillError)
