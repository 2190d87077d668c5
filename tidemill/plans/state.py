"""What runs leave for later runs: high-water marks, schemas, finished tasks."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.base import Folder, publish
from tidemill.sources.commits import recover

#: A run in the history; times are seconds since 1970.
RUN_SCHEMA = "pipeline string, execution_id string, status string, started_at double, recorded_at double, seconds double, rows_in long, rows_out long, rows_rejected long"


class StateStore:
    """Small JSON documents in a folder that driver restarts outlive; each save replaces its document whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, key: tuple[str, ...]) -> Folder:
        return Folder(self.spark, "/".join([self.path, *("".join(c if c.isalnum() or c in "-_." else "_" for c in k) for k in key)]) + ".json")

    def get(self, *key: str):
        file = self._file(key)
        if not file.exists():
            return None
        stream = file.fs.open(file.path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, value, *key: str) -> None:
        file = self._file(key)
        staging = file.sibling()
        stream = staging.fs.create(staging.path, True)
        stream.write(bytearray(json.dumps(value, default=str).encode()))
        stream.close()
        staging.replace(file)

    def forget(self, *key: str) -> None:
        self._file(key).delete()

    def record_run(self, pipeline: str, result: dict) -> None:
        """Keep a run's outcome for :meth:`history`."""
        now = time.time()
        self.put({"pipeline": pipeline, "started_at": now - (result.get("seconds") or 0.0)} | result | {"recorded_at": now}, "runs", pipeline, f"{time.time_ns()}")

    def history(self, pipeline: str | None = None) -> DataFrame:
        """Past runs, one row each: those that :meth:`compact_history` has made one table of, and the documents since.

        A run that is in both, as after a crash between the two steps of compaction, counts once.
        """
        recover(self.spark, f"{self.path}/history")
        table, single = Folder(self.spark, f"{self.path}/history"), Folder(self.spark, f"{self.path}/runs")
        found = self.spark.createDataFrame([], RUN_SCHEMA)
        if table.exists():
            found = found.unionByName(self.spark.read.schema(RUN_SCHEMA).parquet(table.path.toString()))
        if single.exists():
            found = found.unionByName(self.spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(single.path.toString()))
        found = found.dropDuplicates(["pipeline", "execution_id", "recorded_at"])
        return found.where(F.col("pipeline") == pipeline) if pipeline is not None else found

    def compact_history(self) -> int:
        """Make the single documents of runs and the table of earlier ones one table; gives the number of its runs."""
        documents = self._run_files()
        held = self.history()
        count = held.count()
        self._replace_history(held)
        for file in documents:
            file.delete()
        return count

    def purge(self, keep: int | None = None, older_than_days: float | None = None) -> int:
        """Forget all but each pipeline's newest ``keep`` runs, or those older than so many days; gives how many went."""
        before = self.compact_history()
        held = self.history()
        if keep is not None:
            place = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("recorded_at"), "execution_id"))
            held = held.withColumn("__n", place).where(F.col("__n") <= keep).drop("__n")
        if older_than_days is not None:
            held = held.where(F.col("started_at") >= time.time() - 86400 * older_than_days)
        self._replace_history(held)
        return before - self.history().count()

    def _replace_history(self, held: DataFrame) -> None:
        publish(held.coalesce(1), f"{self.path}/history", "overwrite", lambda w, p: w.parquet(p))

    def _run_files(self) -> list[Folder]:
        top = Folder(self.spark, f"{self.path}/runs")
        if not top.exists():
            return []
        found = []
        for s in top.fs.listStatus(top.path):
            found += [Folder(self.spark, x.getPath().toString()) for x in top.fs.listStatus(s.getPath()) if x.getPath().getName().endswith(".json")]
        return found

    def statistics(self, pipeline: str | None = None, days: float = 30, now: float | None = None) -> DataFrame:
        """For each pipeline its runs that began within ``days``: counts, rates, rows, and the average, 95th percentile and most of their seconds."""
        since = (time.time() if now is None else now) - 86400 * days
        return run_statistics(self.history(pipeline).where(F.col("started_at") >= since))

    def timeline(self, limit: int = 100) -> DataFrame:
        """The newest runs of all pipelines."""
        return self.history().orderBy(F.desc("started_at"), "execution_id").limit(limit).select("pipeline", "execution_id", "status", "started_at", "seconds", "rows_out")


def run_statistics(runs: DataFrame) -> DataFrame:
    """One row for each ``pipeline`` of a table of runs.

    Percentile and average are of runs that took any time; the percentile is the value at 95 per cent of the sorted
    ones, counted from below.
    """
    took = F.when(F.col("seconds") > 0, F.col("seconds"))
    grouped = runs.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("runs_total"),
        F.count_if(F.col("status") == "success").alias("runs_succeeded"),
        F.count_if(F.col("status") == "failed").alias("runs_failed"),
        F.sum(F.coalesce("rows_in", F.lit(0))).alias("rows_read"),
        F.sum(F.coalesce("rows_out", F.lit(0))).alias("rows_written"),
        F.sum(F.coalesce("rows_rejected", F.lit(0))).alias("rows_rejected"),
        F.round(F.coalesce(F.avg(took), F.lit(0.0)), 3).alias("avg_seconds"),
        F.round(F.coalesce(F.max(took), F.lit(0.0)), 3).alias("max_seconds"),
        F.count(took).alias("__timed"),
    )
    # the value at a place of all: by rank, so that a pipeline with very many runs isn't gathered
    timed = runs.where(took.isNotNull()).select("pipeline", "seconds")
    counts = timed.groupBy("pipeline", "seconds").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pipeline").orderBy("seconds"))
    ranked = counts.withColumn("upto", upto).join(grouped.select(F.col("pipeline").alias("p"), F.col("__timed").alias("timed")), F.col("pipeline").eqNullSafe(F.col("p")))
    at = F.least(F.col("timed") - 1, F.floor(F.col("timed") * 0.95).cast("long"))
    high = ranked.where(F.col("upto") > at).groupBy("p").agg(F.round(F.min("seconds"), 3).alias("p95_seconds"))
    out = grouped.join(high, grouped["pipeline"].eqNullSafe(high["p"]), "left")
    rate = lambda c: F.round(F.col(c) / F.col("runs_total"), 4)
    return out.select("pipeline", "runs_total", "runs_succeeded", "runs_failed", rate("runs_succeeded").alias("success_rate"), rate("runs_failed").alias("failure_rate"), "rows_read", "rows_written", "rows_rejected", "avg_seconds", F.coalesce("p95_seconds", F.lit(0.0)).alias("p95_seconds"), "max_seconds")
