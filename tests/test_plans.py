import pytest

from tidemill.errors import ConfigurationError
from tidemill.plans.runner import Runner
from tidemill.plans.spec import load_document, parse_pipeline
from tidemill.plans.state import StateStore
from tidemill.sources import read_source, write_sink
from tidemill.streaming import incremental

ORDERS = """﻿Order ID,Customer ID,Customer Email,Quantity,Unit Price,Discount,Currency,Region,Order Date,Status
1,c1,a@x.com,2,49.99,0.10,EUR,EU,2026-01-01,paid
2,c2,b@x.com,1,199.00,0,USD,US,2026-01-02,paid
3,c3,not-an-email,1,5.00,0,EUR,EU,2026-01-02,paid
1,c1,a@x.com,2,49.99,0.10,EUR,EU,2026-01-01,paid
"""

PIPELINE = """
variables: {{root: "{root}"}}
pipeline:
  name: daily
  tasks:
    - id: load
      source: {{type: csv, path: "${{var.root}}/orders.csv"}}
      transformations:
        - {{type: normalize_columns}}
        - {{type: cast, columns: {{quantity: integer, unit_price: decimal, discount: decimal}}}}
        - {{type: derive, column: total, expression: "float(quantity * unit_price * (1 - discount))"}}
      validation:
        on_failure: quarantine
        rules:
          - {{type: email, field: customer_email}}
          - {{type: unique, field: order_id}}
      destination: {{type: parquet, path: "${{var.root}}/out", mode: overwrite}}
      rejects: {{type: json, path: "${{var.root}}/bad", mode: overwrite}}
    - id: summary
      depends_on: [load]
      condition: "state.load.rows_out > 1"
      source: {{type: parquet, path: "${{var.root}}/out"}}
      transformations:
        - {{type: aggregate, group_by: region, aggregations: {{revenue: {{column: total, function: sum}}, n: {{column: order_id, function: count}}}}}}
        - {{type: sort, columns: region}}
      destination: {{type: csv, path: "${{var.root}}/summary", mode: overwrite}}
"""


def test_pipeline_end_to_end(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS, encoding="utf-8")
    (tmp_path / "p.yaml").write_text(PIPELINE.format(root=tmp_path))
    pipeline = parse_pipeline(load_document(tmp_path / "p.yaml"))
    state = StateStore(spark, str(tmp_path / "state"))
    result = Runner(spark, state).run(pipeline)
    assert result.status == "success", {k: r.error for k, r in result.tasks.items()}
    load = result.tasks["load"]
    assert (load.rows_in, load.rows_out, load.rows_rejected) == (4, 2, 2)
    bad = read_source(spark, {"type": "jsonl", "path": str(tmp_path / "bad"), "format": "lines"})
    assert sorted(r["_violations"] for r in bad.collect()) == ["[email] not an e-mail address", "[unique] value is not unique"]
    rows = read_source(spark, {"type": "csv", "path": str(tmp_path / "summary")}).collect()
    assert sorted((r["region"], float(r["revenue"]), r["n"]) for r in rows) == [("EU", 89.982, "1"), ("US", 199.0, "1")]
    assert state.history("daily").count() == 1


def test_incremental_marks_and_failures(spark, tmp_path):
    spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02")], "id long, ts string").write.parquet(str(tmp_path / "in"))
    task = {"id": "t", "source": {"type": "parquet", "path": str(tmp_path / "in")}, "extraction": {"mode": "incremental", "column": "ts", "drift": "additive"}, "destination": {"type": "memory", "dataset": "inc", "mode": "append"}}
    state = StateStore(spark, str(tmp_path / "state"))
    run = lambda **more: Runner(spark, state).run(parse_pipeline({"name": "p", "tasks": [task | more]}))
    failed = run(validation={"rules": [{"type": "range", "field": "id", "min": 2}]})
    assert failed.status == "failed" and state.get("marks", "p", "t") is None
    assert run().tasks["t"].rows_out == 2 and state.get("marks", "p", "t") == "2026-01-02"
    assert run().tasks["t"].rows_out == 0
    spark.createDataFrame([(3, "2026-01-03")], "id long, ts string").write.mode("append").parquet(str(tmp_path / "in"))
    assert run().tasks["t"].rows_out == 1
    assert sorted(r["id"] for r in read_source(spark, {"type": "memory", "dataset": "inc"}).collect()) == [1, 2, 3]


def test_order_of_tasks_and_resume(spark, tmp_path):
    good = {"source": {"type": "inline", "records": [{"a": 1}]}, "destination": {"type": "null"}}
    bad = {"source": {"type": "parquet", "path": str(tmp_path / "none")}, "destination": {"type": "null"}}
    state = StateStore(spark, str(tmp_path / "state"))
    tasks = [{"id": "a", **good}, {"id": "b", "depends_on": ["a"], "on_failure": "continue", **bad}, {"id": "c", "depends_on": ["b"], **good}, {"id": "d", "depends_on": ["a"], **good}]
    first = Runner(spark, state).run(parse_pipeline({"name": "q", "tasks": tasks}))
    assert first.status == "partial" and {k: r.status for k, r in first.tasks.items()} == {"a": "success", "b": "failed", "c": "blocked", "d": "success"}
    tasks[1] = {"id": "b", "depends_on": ["a"], **good}
    again = Runner(spark, state).run(parse_pipeline({"name": "q", "tasks": tasks}), resume=True)
    assert again.status == "success" and again.tasks["a"].status == "resumed" and again.tasks["c"].status == "success"
    with pytest.raises(ConfigurationError):
        Runner(spark).run(parse_pipeline({"name": "r", "tasks": [{"id": "x", "depends_on": ["y"], **good}, {"id": "y", "depends_on": ["x"], **good}]}))


@pytest.mark.parametrize("kind", ["csv", "json", "xml", "parquet", "excel"])
def test_file_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "é <b>", True), (2, None, False)], "id long, name string, ok boolean")
    path = str(tmp_path / f"x.{kind if kind != 'excel' else 'xlsx'}")
    write_sink(df, {"type": kind, "path": path})
    more = {"record_tag": "record"} if kind == "xml" else {"format": "lines"} if kind == "json" else {}
    back = read_source(spark, {"type": kind, "path": path, **more}).select("id", "name").collect()
    assert sorted((int(float(r["id"])), r["name"]) for r in back) == [(1, "é <b>"), (2, None)]


def test_sqlite_modes(spark, tmp_path):
    db = str(tmp_path / "x.db")
    df = spark.createDataFrame([(i, f"n{i}", [i]) for i in range(50)], "id long, name string, tags array<long>")
    sink = {"type": "sqlite", "database": db, "table": "t"}
    write_sink(df, sink | {"create_table": True, "key_columns": ["id"], "mode": "append"})
    write_sink(df.limit(5).selectExpr("id", "'new' as name"), sink | {"mode": "upsert", "key_columns": "id", "columns": ["id", "name"]})
    back = read_source(spark, {"type": "sqlite", "database": db, "table": "t", "where": "id < 40", "columns": ["id", "name"]})
    assert back.count() == 40 and back.where("name = 'new'").count() == 5
    with pytest.raises(Exception, match="has rows"):
        write_sink(df, sink | {"mode": "error_if_exists"})
    with pytest.raises(ConfigurationError):
        read_source(spark, {"type": "sqlite", "database": db, "table": "t", "where": "1=1; drop table t"})


def test_stream_of_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.file_stream(spark, "parquet", str(tmp_path / "in"), "id long, v string")
    run = lambda: incremental.run_available(stream(), str(tmp_path / "check"), incremental.parquet_batches(str(tmp_path / "out")), [{"type": "filter", "expression": "id > 1"}])
    assert run() == 1 and run() == 0
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_signals_stop_a_run_that_can_be_resumed(spark, tmp_path):
    import os
    import signal
    import threading
    import time

    slow = tmp_path / "slow"
    spark.range(4).repartition(4).write.parquet(str(slow))
    spec = {"name": "p", "tasks": [
        {"id": "a", "source": {"type": "inline", "records": [{"v": 1}]}, "destination": {"type": "parquet", "path": str(tmp_path / "a")}},
        {"id": "b", "depends_on": ["a"], "source": {"type": "parquet", "path": str(slow)}, "transformations": [{"type": "wait_for_test"}], "destination": {"type": "parquet", "path": str(tmp_path / "b")}},
        {"id": "c", "depends_on": ["a"], "source": {"type": "parquet", "path": str(slow)}, "destination": {"type": "parquet", "path": str(tmp_path / "c")}},
    ]}
    spec["tasks"][2]["depends_on"] = ["b"]
    from tidemill.operators.base import STEPS

    waits = {"seconds": 60}

    @STEPS.register("wait_for_test")
    def wait(df, context):
        seconds = waits["seconds"]

        def work(batches):
            for pdf in batches:
                time.sleep(seconds)
                yield pdf

        return df.mapInPandas(work, df.schema)

    state = StateStore(spark, str(tmp_path / "s"))
    try:
        sent = threading.Timer(6, lambda: os.kill(os.getpid(), signal.SIGTERM))
        handler = signal.getsignal(signal.SIGTERM)
        began = time.time()
        sent.start()
        result = Runner(spark, state).run(parse_pipeline(spec))
        assert time.time() - began < 50 and signal.getsignal(signal.SIGTERM) is handler
        assert (result.status, result.tasks["a"].status, result.tasks["b"].status, result.tasks["c"].status) == ("failed", "success", "failed", "blocked")
        waits["seconds"] = 0
        again = Runner(spark, state).run(parse_pipeline(spec), resume=True)
        assert again.status == "success" and again.tasks["a"].status == "resumed"
    finally:
        STEPS._found.pop("wait_for_test", None)


def test_what_a_task_stages_goes_with_it(spark, tmp_path, monkeypatch):
    from tidemill.plans import staging

    monkeypatch.setattr(staging, "staging_dir", lambda _: str(tmp_path / "stage"))
    source = {"type": "inline", "records": [{"v": 1}, {"v": 2}, {"v": 2}]}
    checks = {"rules": [{"type": "unique", "field": "v"}], "on_failure": "drop"}
    for sink in ({"type": "parquet", "path": str(tmp_path / "t")}, {"type": "memory", "dataset": "kept_for_test"}):
        spec = {"name": "p", "tasks": [{"id": "t", "source": source, "validation": checks, "destination": sink}]}
        assert Runner(spark).run(parse_pipeline(spec)).status == "success"
        left = list((tmp_path / "stage" / "staged").iterdir())
        assert len(left) == (sink["type"] == "memory")
    assert read_source(spark, {"type": "memory", "dataset": "kept_for_test"}).count() == 2
