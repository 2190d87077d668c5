"""Aggregates over all runs: each run adds the states of its own rows, and the states of all runs are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import col, names_of
from tidemill.operators.aggregates import AGGREGATES
from tidemill.sources.base import SINKS, Folder, mode_of, publish


class Rollup:
    """States by group below ``path``, a folder for each batch; a batch that is added again replaces its states."""

    def __init__(self, spark: SparkSession, path: str, group_by, aggregations: dict):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), names_of(group_by)
        self.specs = {n: {"function": s} if isinstance(s, str) else s for n, s in aggregations.items()}

    def _made(self, name: str):
        return AGGREGATES.get(self.specs[name].get("function", "sum"))

    def add(self, df: DataFrame, number: int) -> None:
        """Keep the states of the rows of batch ``number``."""
        made = []
        for name, spec in self.specs.items():
            column = spec.get("column", name)
            if column not in df.columns:
                raise ConfigurationError(f"rollup: no column {column!r}")
            made.append(self._made(name).partial(col(column), df.schema[column].dataType).alias(name))
        states = df.groupBy(*(col(k) for k in self.keys)).agg(*made, F.count(F.lit(1)).alias("__rows")).where("__rows > 0")
        folder = Folder(self.spark, f"{self.path}/batch={number}")
        folder.fs.mkdirs(folder.path.getParent())
        publish(states, folder.path.toString(), "overwrite", lambda w, p: w.parquet(p))

    def _states(self) -> DataFrame:
        held = self.spark.read.option("recursiveFileLookup", True).parquet(self.path)
        merged = [self._made(n).merge(col(n)).alias(n) for n in self.specs]
        return held.groupBy(*(col(k) for k in self.keys)).agg(*merged, F.sum("__rows").alias("__rows"))

    def result(self) -> DataFrame:
        """One row for each group, over all batches."""
        finals = [self._made(n).final(col(n)).alias(n) for n in self.specs]
        return self._states().select(*(col(k) for k in self.keys), *finals)

    def compact(self) -> None:
        """Make the states of all batches one; none of them can be replaced alone any more."""
        publish(self._states(), self.path, "overwrite", lambda w, p: w.parquet(p))


@SINKS.register("rollup")
def write_rollup(df: DataFrame, path: str, group_by, aggregations: dict, batch: int, mode: str | None = None) -> None:
    """Add the rows as a batch to the rollup below ``path``."""
    mode_of(mode, ("overwrite",))
    Rollup(df.sparkSession, path, group_by, aggregations).add(df, batch)
