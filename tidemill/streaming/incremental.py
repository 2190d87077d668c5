"""Chains over Structured Streaming sources.

A stream run takes what has arrived since the last one (``availableNow``) and ends; Spark's
checkpoint plays the part of the high-water mark.  Chains are applied to each micro-batch as
to a table, so every step and rule works; a batch is published under its number once.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import col, names_of
from tidemill.operators import apply_steps
from tidemill.operators.base import StepContext
from tidemill.plans.extraction import first_changes
from tidemill.plans.seen import SeenKeys
from tidemill.plans.staging import scratch, staged
from tidemill.plans.state import StateStore
from tidemill.sources.base import Folder


def file_stream(spark: SparkSession, format: str, path: str, schema, **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def distinct_within(df: DataFrame, columns, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within a watermark's delay; state for older keys is dropped."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(names_of(columns))


def windowed(df: DataFrame, event_time: str, length: str, keys=(), slide: str | None = None, delay: str = "10 minutes", **aggregates) -> DataFrame:
    """Aggregates for event-time windows: ``aggregates`` maps names to columns."""
    moment = F.window(col(event_time), length, slide) if slide else F.window(col(event_time), length)
    grouped = df.withWatermark(event_time, delay).groupBy(moment.alias("window"), *(col(k) for k in names_of(list(keys))))
    out = grouped.agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *(col(c) for c in out.columns if c != "window"))


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], steps: list[dict] | None = None, context: StepContext | None = None) -> int:
    """Process all that is there in micro-batches and stop; gives the number of batches."""
    count = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal count
        count += 1
        write(apply_steps(rows, steps or [], context), number)

    query = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return count


def first_of_keys(write: Callable[[DataFrame, int], None], seen: SeenKeys, keys: list[str], event_time: str | None = None) -> Callable[[DataFrame, int], None]:
    """A writer of the first row of each key over all batches of a stream.

    ``seen`` keeps the keys; with its ``ttl`` a key counts as new again after so many seconds, by
    the batch's latest ``event_time`` or else by the clock.  A repeated batch gives the same rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        at = time.time()
        if event_time is not None:
            at = rows.agg(F.max(F.unix_micros(col(event_time).cast("timestamp")) / 1e6)).first()[0] or 0.0
        rows = rows.withColumn("__at", F.monotonically_increasing_id())
        with scratch(rows.sparkSession):
            fresh = staged(seen.unseen(first_changes(rows, keys, "__at"), keys, number, at).drop("__at"))
            seen.record(fresh, keys, number, at)
            write(fresh, number)
        seen.compact(number, at, len(keys))

    return batch


def parquet_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that keeps each batch in a folder of its own, so that a repeated batch replaces itself."""

    def write(rows: DataFrame, number: int) -> None:
        target = Folder(rows.sparkSession, f"{path}/batch={number}")
        staging = target.sibling()
        rows.write.parquet(staging.path.toString())
        if target.exists():
            target.delete()
        else:
            target.fs.mkdirs(target.path.getParent())
        staging.rename(target)

    return write


class LateAwareWindows:
    """Event-time windows in append mode, with the rows that come too late beside them.

    A batch's watermark is the latest event time of the batches before it, less ``delay``.  Rows whose
    window ends by the watermark are late and go to ``late`` as they are; others wait in ``state``.
    A window is published once, by the first batch whose rows move the watermark to its end.  All is kept under the batch's
    number, so a batch that is repeated, after a crash at any point, replaces what it left.
    """

    def __init__(self, spark: SparkSession, out: str, late: str, state: str, event_time: str, length: str, keys=(), delay: str = "10 minutes", **aggregates):
        self.spark, self.out, self.late, self.state = spark, out, late, state.rstrip("/")
        self.event_time, self.length, self.keys, self.delay, self.aggregates = event_time, length, names_of(list(keys)), delay, aggregates
        self.marks = StateStore(spark, f"{self.state}/marks")

    def _mark(self, number: int) -> dict:
        """The watermark after a batch, in microseconds, and the latest end of a window that each batch has rows of."""
        found = self.marks.get(str(number)) if number >= 0 else None
        return found or {"watermark": None, "ends": {}}

    def __call__(self, rows: DataFrame, number: int) -> None:
        with scratch(self.spark):
            self._batch(rows, number)

    def _batch(self, rows: DataFrame, number: int) -> None:
        before = self._mark(number - 1)
        moment = F.window(col(self.event_time), self.length)
        placed = staged(rows.withColumns({"__start": moment["start"], "__end": moment["end"]}).where("__end IS NOT NULL"))
        mark = F.lit(before["watermark"]).cast("long")
        is_late = F.coalesce(F.unix_micros("__end") <= mark, F.lit(False))
        parquet_batches(self.late)(placed.where(is_late).drop("__start", "__end"), number)
        parquet_batches(f"{self.state}/rows")(placed.where(~is_late), number)
        facts = placed.agg(F.max(F.unix_micros(col(self.event_time).cast("timestamp") - F.expr(f"INTERVAL {self.delay}"))).alias("mark"), F.max(F.unix_micros(F.when(~is_late, col("__end")))).alias("end")).first()
        after = max((m for m in (before["watermark"], facts["mark"]) if m is not None), default=None)
        ends = before["ends"] | ({str(number): facts["end"]} if facts["end"] is not None else {})
        # batches whose windows all ended before this one hold nothing that is open
        open_ = {b: e for b, e in ends.items() if before["watermark"] is None or e > before["watermark"]}
        held = self.spark.read.schema(placed.schema).parquet(*(f"{self.state}/rows/batch={b}" for b in open_)) if open_ else placed.where("false")
        end = F.unix_micros("__end")
        closing = held.where((end <= F.lit(after).cast("long")) & (F.lit(True) if before["watermark"] is None else end > mark))
        grouped = closing.groupBy(F.col("__start").alias("window_start"), F.col("__end").alias("window_end"), *(col(k) for k in self.keys))
        parquet_batches(self.out)(grouped.agg(*(c.alias(n) for n, c in self.aggregates.items())), number)
        self.marks.put({"watermark": after, "ends": open_}, str(number))
        for b in set(self._mark(number - 2)["ends"]) - set(before["ends"]) if number > 1 else ():
            Folder(self.spark, f"{self.state}/rows/batch={b}").delete()  # not even the last batch, were it repeated, needs these
