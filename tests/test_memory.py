"""Keys and sequences across runs and micro-batches: parts of a table give what the whole table gives, and doing a part again changes nothing."""

import pytest

from tidemill.operators import rules
from tidemill.plans.runner import Runner
from tidemill.plans.seen import SeenKeys
from tidemill.plans.spec import parse_pipeline
from tidemill.plans.state import StateStore
from tidemill.sources.base import read_source
from tidemill.streaming import incremental as streams

ROWS = [(i, f"k{i * 7 % 23}" if i % 11 else None, i * 13 % 40) for i in range(90)]
PARTS = [ROWS[:30], ROWS[30:60], ROWS[60:]]


def pipeline(tmp_path, rows, number, **task):
    records = [{"id": i, "k": k, "v": v} for i, k, v in rows]
    target = str(tmp_path / f"out{number}")
    spec = {"id": "t", "source": {"type": "inline", "records": records}, "destination": {"type": "parquet", "path": target}} | task
    return parse_pipeline({"name": "p", "tasks": [spec]}), target


def ids(spark, path):
    return sorted(r["id"] for r in read_source(spark, {"type": "parquet", "path": path}).collect())


def in_parts(spark, tmp_path, name, again=(), **task):
    """Ids published over three runs; those of ``again`` fail once after their rows were checked and are run again."""
    state = StateStore(spark, str(tmp_path / name))
    out = []
    for n, rows in enumerate(PARTS):
        spec, target = pipeline(tmp_path, rows, f"{name}{n}", **task)
        if n in again:
            broken, _ = pipeline(tmp_path, rows, f"{name}{n}", **task)
            broken.tasks[0].destination["mode"] = "no such mode"
            assert Runner(spark, state).run(broken).status == "failed"
        result = Runner(spark, state).run(spec)
        assert result.status == "success", result.tasks["t"].error
        out += ids(spark, target)
    return sorted(out)


@pytest.mark.parametrize("again", [(), (0, 1, 2)])
def test_cdc_keys_across_runs(spark, tmp_path, again):
    found = in_parts(spark, tmp_path, "cdc", again, extraction={"mode": "cdc", "column": "id", "key_columns": "k", "order_by": "id", "remember": True})
    first = {}
    for i, k, _ in ROWS:
        first.setdefault(k, i)
    assert found == sorted(first.values())


@pytest.mark.parametrize("again", [(), (1,)])
def test_unique_and_sequence_across_runs(spark, tmp_path, again):
    checks = [{"type": "unique", "field": "k", "order_by": "id", "across_runs": True}, {"type": "sequence", "field": "v", "order_by": "id", "across_runs": True, "severity": "error"}]
    found = in_parts(spark, tmp_path, "rules", again, validation={"rules": checks, "on_failure": "drop"})
    whole = spark.createDataFrame(ROWS, "id long, k string, v long")
    good, _, _ = rules.split(rules.checked(whole, [{k: v for k, v in c.items() if k != "across_runs"} for c in checks]), "drop")
    assert found == sorted(r["id"] for r in good.collect())


def keys_of(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def fresh(seen, df, number, at=0.0):
    found = seen.unseen(df, ["k"], number, at)
    rows = sorted({r["k"] for r in found.collect()}, key=str)
    seen.record(found, ["k"], number, at)
    return rows


def test_replays_look_at_earlier_batches_only(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "s"))
    assert fresh(seen, keys_of(spark, ["a", "b", None]), 1) == [None, "a", "b"]
    assert fresh(seen, keys_of(spark, ["b", "c"]), 2) == ["c"]
    assert fresh(seen, keys_of(spark, ["c", "d", None]), 3) == ["d"]
    assert fresh(seen, keys_of(spark, ["b", "c"]), 2) == ["c"]  # again
    assert fresh(seen, keys_of(spark, ["b", "x"]), 2) == ["x"]  # another try of it replaces its keys
    assert fresh(seen, keys_of(spark, ["c", "d", "x"]), 3) == ["c", "d"]


def test_compacted_keys_and_time_to_live(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "s"), ttl=100.0, buckets=4)
    for n in range(1, 6):
        assert fresh(seen, keys_of(spark, [f"k{n}", "k1"]), n, at=10.0 * n) == ([f"k{n}"] if n > 1 else ["k1"])
    assert seen.compact(6, 60.0, 1, most=3) and not seen.compact(6, 60.0, 1, most=3)
    assert fresh(seen, keys_of(spark, ["k1", "k5", "k6"]), 6, at=60.0) == ["k6"]
    again = SeenKeys(spark, str(tmp_path / "s"), ttl=100.0)  # another driver finds the table
    assert fresh(again, keys_of(spark, ["k1", "k5", "k6", "k7"]), 7, at=125.0) == ["k1", "k7"]  # k1 was seen at 10
    with pytest.raises(ValueError):
        seen.known(3, 0.0, 1)
    plan = again.known(8, 130.0, 1).distinct()._jdf.queryExecution().toString()
    assert "tidemill_seen_" in plan


def test_streams_of_several_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, k string, v long"
    seen = SeenKeys(spark, str(tmp_path / "seen"))
    for n, rows in enumerate(PARTS):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.file_stream(spark, "parquet", folder, schema)
        write = streams.first_of_keys(streams.parquet_batches(out), seen, ["k"])
        assert streams.run_available(stream, str(tmp_path / "checkpoint"), write) == 1
        if n == 1:  # the last batch comes again
            write(spark.createDataFrame(rows, schema), 1)
    first = {}
    for i, k, _ in ROWS:
        first.setdefault(k, i)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == sorted(first.values())
