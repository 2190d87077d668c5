"""What a task's runs know of its earlier ones: keys seen first, and greatest values of sequences.

A run that publishes ends a batch; one that fails is tried again under the same number and
finds what its first try found.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import col, names_of
from tidemill.operators import rules as quality
from tidemill.plans import extraction
from tidemill.plans.seen import SeenKeys
from tidemill.plans.state import StateStore


class RunMemory(quality.Memory):
    """The memory of one task of a pipeline."""

    def __init__(self, spark: SparkSession, state: StateStore, pipeline: str, task: str, at: float | None = None):
        self.spark, self.state, self.place = spark, state, (pipeline, task)
        self.number = (state.get("batches", pipeline, task) or 0) + 1
        self.at = time.time() if at is None else at
        self.used: list[tuple[SeenKeys, int]] = []

    def _keys(self, what: str, ttl) -> SeenKeys:
        name = "".join(c if c.isalnum() or c in "-_." else "_" for c in what)
        return SeenKeys(self.spark, "/".join([self.state.path, "seen", *self.place, name]), ttl)

    @staticmethod
    def _ttl(spec) -> float | None:
        return spec.get("ttl") if isinstance(spec, dict) else None

    # -- change capture ----------------------------------------------------------------

    def first_seen(self, df: DataFrame, key_columns, remember) -> DataFrame:
        """The rows whose key no earlier run has delivered."""
        return self._keys("cdc", self._ttl(remember)).unseen(df, names_of(key_columns), self.number, self.at)

    def record_keys(self, df: DataFrame, key_columns, remember) -> None:
        keys = names_of(key_columns)
        seen = self._keys("cdc", self._ttl(remember))
        seen.record(df, keys, self.number, self.at)
        self.used.append((seen, len(keys)))

    # -- rules -------------------------------------------------------------------------

    def flag(self, df: DataFrame, spec: dict, keys: list[str], name: str) -> DataFrame:
        known = self._keys("unique-" + "-".join(keys), self._ttl(spec)).flagged(df, keys, self.number, self.at, "__known")
        return known.withColumn(name, col(name) | col("__known")).drop("__known")

    def greatest(self, spec: dict):
        found = self.state.get("greatest", *self.place, spec["field"])
        if not found:
            return None
        return found["before"] if found["number"] >= self.number else found["value"]

    def record_rules(self, df: DataFrame, rules: list[dict]) -> None:
        """Keep the keys and greatest values of all rows, accepted or not."""
        for s in rules:
            if not s.get("across_runs"):
                continue
            if quality.RULES.key(s["type"]) in ("unique", "distinct"):
                keys = names_of(s.get("columns")) or [s["field"]]
                seen = self._keys("unique-" + "-".join(keys), self._ttl(s))
                seen.record(df, keys, self.number, self.at)
                self.used.append((seen, len(keys)))
            elif quality.RULES.key(s["type"]) in ("sequence", "monotonic"):
                before, top = self.greatest(s), extraction.highest(df, s["field"])
                if before is not None:  # the greater one, as the column's type compares them
                    both = df.sparkSession.range(1).select(F.greatest(*(F.lit(v).cast(df.schema[s["field"]].dataType) for v in (before, top))).alias(s["field"]))
                    top = extraction.highest(both, s["field"])
                self.state.put({"number": self.number, "before": before, "value": top}, "greatest", *self.place, s["field"])

    def done(self) -> None:
        """The run has published; the next one is another batch."""
        self.state.put(self.number, "batches", *self.place)
        for seen, width in self.used:
            seen.compact(self.number + 1, self.at, width)
