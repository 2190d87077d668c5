import time

import pytest

from tidemill.plans.state import StateStore


def filled(spark, tmp_path):
    state = StateStore(spark, str(tmp_path / "s"))
    for i in range(8):
        status = "failed" if i % 4 == 3 else "success"
        state.record_run("a" if i < 6 else "b", {"execution_id": f"e{i}", "status": status, "seconds": float(i), "rows_in": 10, "rows_out": i, "rows_rejected": 1, "started_at": time.time() - 86400 * i})
    return state


def test_statistics_before_and_after_compaction(spark, tmp_path):
    state = filled(spark, tmp_path)
    before = sorted(map(str, state.statistics().collect()))
    assert state.compact_history() == 8 and not list((tmp_path / "s" / "runs").rglob("*.json"))
    assert sorted(map(str, state.statistics().collect())) == before
    a = next(r for r in state.statistics().collect() if r["pipeline"] == "a")
    assert (a["runs_total"], a["runs_succeeded"], a["success_rate"], a["failure_rate"], a["rows_read"], a["rows_written"], a["rows_rejected"]) == (6, 5, 0.8333, 0.1667, 60, 15, 6)
    assert (a["avg_seconds"], a["p95_seconds"], a["max_seconds"]) == (3.0, 5.0, 5.0)
    assert [r["execution_id"] for r in state.timeline(3).collect()] == ["e0", "e1", "e2"]
    assert state.statistics(days=2.5).collect()[0]["runs_total"] == 3
    state.record_run("b", {"execution_id": "new", "status": "success", "seconds": 1.0})
    assert state.history("b").count() == 3 and state.history().count() == 9
    assert StateStore(spark, str(tmp_path / "other")).statistics().collect() == []


def test_purge_keeps_the_newest(spark, tmp_path):
    state = filled(spark, tmp_path)
    assert state.purge(keep=2) == 4
    assert sorted(r["execution_id"] for r in state.history().collect()) == ["e4", "e5", "e6", "e7"]
    assert state.purge(older_than_days=5.5) == 2
    assert sorted(r["execution_id"] for r in state.history().collect()) == ["e4", "e5"]


def test_a_crash_between_the_steps_counts_no_run_twice(spark, tmp_path, monkeypatch):
    from tidemill.sources.base import Folder

    state = filled(spark, tmp_path)
    files = state._run_files()
    monkeypatch.setattr(state, "_run_files", lambda: [])  # the documents stay beside the table
    state.compact_history()
    assert files and all(f.exists() for f in files) and isinstance(files[0], Folder)
    assert state.history().count() == 8
    monkeypatch.undo()
    assert state.compact_history() == 8 and state.history().count() == 8


def test_runner_records_what_statistics_need(spark, tmp_path):
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline

    state = StateStore(spark, str(tmp_path / "s"))
    spec = {"name": "p", "tasks": [{"id": "t", "source": {"type": "inline", "records": [{"v": 1}, {"v": 2}]}, "destination": {"type": "null"}}]}
    assert Runner(spark, state).run(parse_pipeline(spec)).status == "success"
    found = state.statistics("p").collect()[0]
    assert (found["runs_total"], found["rows_read"], found["success_rate"]) == (1, 2, 1.0) and found["p95_seconds"] > 0
    assert pytest.approx(found["p95_seconds"], abs=0.002) == found["avg_seconds"]
