"""Running pipelines: each task is one lazy plan, staged once and then published."""

from __future__ import annotations

import random
import signal
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError, PublishError, TidemillError
from tidemill.functions.columns import ORDINAL
from tidemill.functions.expressions import evaluate
from tidemill.operators import apply_steps
from tidemill.operators import rules as quality
from tidemill.operators.base import StepContext
from tidemill.plans import extraction
from tidemill.plans.spec import PipelineSpec, TaskSpec, levels
from tidemill.plans.staging import scratch, staged
from tidemill.plans.memory import RunMemory
from tidemill.plans.state import StateStore
from tidemill.sources import read_source
from tidemill.sources.base import after_publishing, publish_all
from tidemill.sources.commits import recover_all

#: Sources that a second reading finds as they were; others are staged.
_REPEATABLE = ("csv", "json", "jsonl", "ndjson", "xml", "parquet", "excel", "xlsx", "memory", "inline", "generator", "synthetic")


@dataclass
class TaskResult:
    """Outcome of one task."""

    id: str
    status: str = "pending"
    rows_in: int = 0
    rows_out: int = 0
    rows_rejected: int = 0
    seconds: float = 0.0
    attempts: int = 0
    error: str | None = None
    report: dict = field(default_factory=dict)


@dataclass
class RunResult:
    """Outcome of a run: success, partial or failed."""

    pipeline: str
    execution_id: str
    status: str
    tasks: dict[str, TaskResult]


class Runner:
    """Runs pipelines on a session, with a state store for marks, schemas and resuming."""

    def __init__(self, spark: SparkSession, state: StateStore | None = None):
        self.spark, self.state = spark, state

    # -- one task ------------------------------------------------------------------

    def plan(self, pipeline: PipelineSpec, task: TaskSpec, context: StepContext, mark=None) -> DataFrame:
        """The source and chain of a task as one lazy DataFrame, before validation."""
        df = read_source(self.spark, task.source)
        how = task.extraction
        kind = how.get("mode", "full")
        if kind not in ("full", "incremental", "cdc"):
            raise ConfigurationError("extraction mode is full, incremental or cdc")
        if kind != "full":
            df = extraction.since(df, how["column"], mark, how.get("overlap", 0))
        if kind == "cdc":
            df = extraction.first_changes(df, how.get("key_columns", []), how.get("order_by"))
        return df

    def _etl(self, pipeline: PipelineSpec, task: TaskSpec, context: StepContext, result: TaskResult, dry_run: bool) -> None:
        name = task.source.get("name", task.source.get("type"))
        mark_key, schema_key = ("marks", pipeline.name, task.id), ("schemas", pipeline.name, task.id, str(name))
        mark = self.state.get(*mark_key) if self.state else None
        memory = RunMemory(self.spark, self.state, pipeline.name, task.id) if self.state else quality.Memory()
        source = self.plan(pipeline, task, context, mark)
        if self.state and task.extraction.get("drift"):
            shape = extraction.described(source)
            found = extraction.drift(self.state.get(*schema_key), shape)
            self.state.put(shape, *schema_key)
            extraction.check_drift(found, task.extraction["drift"])
        if task.extraction.get("mode", "full") != "full" or str(task.source.get("type")).lower() not in _REPEATABLE:
            source = staged(source)  # so that counts, marks and rows are of one reading
        remember = task.extraction.get("remember")
        if task.extraction.get("mode") == "cdc" and remember and self.state:
            source = staged(memory.first_seen(source, task.extraction.get("key_columns", []), remember))
        result.rows_in = source.count()
        check = task.validation
        before = check.get("stage") == "pre_transform"
        bad = None
        df = source
        for step in ("rules", "chain") if before else ("chain", "rules"):
            if step == "chain":
                df = apply_steps(df, task.transformations, context)
            elif check.get("rules") or check.get("schema"):
                held = staged(quality.checked(df, check.get("rules", []), check.get("schema"), memory))
                if self.state and not dry_run:
                    memory.record_rules(held, check.get("rules", []))
                df, bad, report = quality.split(held, check.get("on_failure", "fail"), check.get("max_errors"), check.get("max_error_rate"))
                result.rows_rejected = report.rejected
                result.report = {"by_rule": report.by_rule, "by_field": report.by_field, "by_severity": report.by_severity}
        ready, outputs = df.drop(ORDINAL), []
        if bad is not None and task.rejects and check.get("on_failure") == "quarantine":
            outputs.append((bad.drop(ORDINAL), task.rejects))
        if dry_run:
            result.rows_out = ready.count()
            return
        if remember and task.extraction.get("mode") == "cdc" and self.state:
            memory.record_keys(source, task.extraction.get("key_columns", []), remember)
        seen = Observation()
        publish_all([*outputs, (ready.observe(seen, F.count(F.lit(1)).alias("n")), task.destination)])
        result.rows_out = seen.get["n"]
        if self.state:
            memory.done()
        if self.state and task.extraction.get("mode", "full") != "full":
            top = extraction.highest(source, task.extraction["column"])
            self.state.put(extraction.later_mark(mark, top), *mark_key)

    def _sql(self, task: TaskSpec, dry_run: bool) -> None:
        if dry_run:
            return
        target = task.destination or {}
        path = target.get("database") or (target.get("dsn") or "").removeprefix("sqlite:///")
        if not path:
            self.spark.sql(task.statement)
            return
        import sqlite3

        with sqlite3.connect(path) as link:
            link.execute(task.statement)

    def _run_task(self, pipeline: PipelineSpec, task: TaskSpec, execution: str, dry_run: bool, done: dict[str, TaskResult]) -> TaskResult:
        result = TaskResult(task.id)
        state = {k: {"rows_in": r.rows_in, "rows_out": r.rows_out, "rows_rejected": r.rows_rejected, "status": r.status} for k, r in done.items()}
        context = StepContext(execution, pipeline.name, task.id, execution, str((task.source or {}).get("type", "")), params=pipeline.params, state=state, read=lambda spec: read_source(self.spark, spec))
        began = time.time()
        retry = task.retry or {}
        tag = f"{execution}-{task.id}"
        late, clock, finished = threading.Event(), None, False
        try:
            if task.condition:
                _, wanted = evaluate(task.condition, {"params": pipeline.params, "state": state, "pipeline": pipeline.name, "task": task.id, "dry_run": dry_run})
                if not wanted:
                    result.status = "skipped"
                    return result
            if task.timeout:
                clock = threading.Timer(task.timeout, self._out_of_time, (tag, late))
                clock.daemon = True
                clock.start()
            for attempt in range(1, max(1, retry.get("attempts", 1)) + 1):
                result.attempts = attempt
                if late.is_set():
                    break
                self.spark.sparkContext.setJobGroup(tag, f"{pipeline.name}.{task.id}", interruptOnCancel=True)
                try:
                    if task.type == "etl":
                        with scratch(self.spark), after_publishing(dry_run):
                            self._etl(pipeline, task, context, result, dry_run)
                    elif task.type == "sql":
                        self._sql(task, dry_run)
                    finished = True
                    break
                except (PublishError, OSError, TimeoutError):
                    if attempt >= retry.get("attempts", 1):
                        raise
                    time.sleep(random.uniform(0, retry.get("delay", 1.0) * 2 ** (attempt - 1)))  # noqa: S311
            result.status = "success"
            if not finished:  # a task that has published in time isn't late any more
                raise TimeoutError
        except Exception as e:
            result.status, result.error = "failed", f"{type(e).__name__}: {e}"[:2000]
            if late.is_set():
                e = PublishError(f"task {task.id!r} took more than {task.timeout} s")
                result.error = f"TimeoutError: {e}"
            if not isinstance(e, TidemillError):
                result.error = f"task {task.id!r}: {result.error}"
        finally:
            if clock is not None:
                clock.cancel()
            result.seconds = time.time() - began
        return result

    def _out_of_time(self, tag: str, late: threading.Event) -> None:
        late.set()
        self.spark.sparkContext.cancelJobGroup(tag)

    # -- a pipeline ----------------------------------------------------------------

    @contextmanager
    def _interruptible(self, execution: str, tasks: list[TaskSpec]):
        """While inside, SIGINT and SIGTERM stop the Spark jobs of all tasks; the run then ends as a failed one that can be resumed.

        A second signal does what it would do without this.  Only the main thread can take signals.
        """
        stopped = threading.Event()
        if threading.current_thread() is not threading.main_thread():
            yield stopped
            return
        before = {s: signal.getsignal(s) for s in (signal.SIGINT, signal.SIGTERM)}

        def stop(number, frame) -> None:
            for s, handler in before.items():
                signal.signal(s, handler)
            stopped.set()
            # not in the handler itself, which may have come amid a call to the JVM
            threading.Thread(target=lambda: [self.cancel(execution, t.id) for t in tasks], daemon=True).start()

        for s in before:
            signal.signal(s, stop)
        try:
            yield stopped
        finally:
            for s, handler in before.items():
                signal.signal(s, handler)

    def cancel(self, execution_id: str, task_id: str) -> None:
        """Stop a task's Spark jobs."""
        self.spark.sparkContext.cancelJobGroup(f"{execution_id}-{task_id}")

    def run(self, pipeline: PipelineSpec, dry_run: bool = False, resume: bool = False, only: list[str] | None = None) -> RunResult:
        """Run tasks level by level; those of a level share the cluster.

        A failed task that says ``continue`` leaves the run partial and its descendants
        skipped; others end the run.  ``resume`` passes over tasks that succeeded before.
        """
        execution = uuid.uuid4().hex
        if not dry_run:
            recover_all(self.spark, [spec for t in pipeline.tasks for spec in (t.destination, t.rejects) if spec])
        done: dict[str, TaskResult] = {}
        finished = set((self.state.get("resume", pipeline.name) or []) if self.state and resume else [])
        with self._interruptible(execution, pipeline.tasks) as stopped:
            self._run_levels(pipeline, execution, dry_run, only, done, finished, stopped)
        return self._ended(pipeline, execution, dry_run, done)

    def _run_levels(self, pipeline: PipelineSpec, execution: str, dry_run: bool, only: list[str] | None, done: dict[str, TaskResult], finished: set[str], stopped: threading.Event) -> None:
        stop = False
        for level in levels(pipeline.tasks):
            todo = []
            for t in level:
                broken = any(done[d].status in ("failed", "blocked") for d in t.depends_on if d in done)
                if only is not None and t.id not in only or t.id in finished:
                    done[t.id] = TaskResult(t.id, "resumed" if t.id in finished else "skipped")
                elif stop or broken or stopped.is_set():
                    done[t.id] = TaskResult(t.id, "blocked")
                else:
                    todo.append(t)
            with ThreadPoolExecutor(max(1, min(pipeline.parallelism, len(todo)))) as pool:
                found = list(pool.map(lambda t: self._run_task(pipeline, t, execution, dry_run, dict(done)), todo))
            for t, r in zip(todo, found):
                done[t.id] = r
                stop |= r.status == "failed" and t.on_failure == "fail"
            finished |= {r.id for r in found if r.status == "success"}
            if self.state and not dry_run:
                self.state.put(sorted(finished), "resume", pipeline.name)

    def _ended(self, pipeline: PipelineSpec, execution: str, dry_run: bool, done: dict[str, TaskResult]) -> RunResult:
        failed = [t for t in pipeline.tasks if done[t.id].status == "failed"]
        stopped = not failed and any(r.status == "blocked" for r in done.values())  # by a signal
        status = "failed" if stopped else "success" if not failed else "failed" if any(t.on_failure == "fail" for t in failed) else "partial"
        if self.state and not dry_run:
            if status == "success":
                self.state.forget("resume", pipeline.name)
            self.state.record_run(pipeline.name, {"execution_id": execution, "status": status, "seconds": sum(r.seconds for r in done.values()), "rows_in": sum(r.rows_in for r in done.values()), "rows_out": sum(r.rows_out for r in done.values()), "rows_rejected": sum(r.rows_rejected for r in done.values())})
        return RunResult(pipeline.name, execution, status, done)
