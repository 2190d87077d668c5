"""Steps that see a whole group of rows in order: Python table functions that Spark partitions and sorts for.

A class with ``eval(row)`` and maybe ``terminate()`` becomes a step.  Spark brings the
rows of a partition together in order and hands them over one at a time, so the class keeps what
it needs of the rows before, and no partition has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import col, names_of
from tidemill.operators.base import STEPS, StepContext
from tidemill.shipping import ship_package


def table_step(*names: str, adds: Callable[..., str]) -> Callable[[Callable], Callable]:
    """Register a step made of a table function.

    The decorated function takes the step's options and gives the class.  ``adds`` takes them
    too and gives the columns, as DDL, that the class yields for each row; they are added to the row's own, and take the
    place of those of the same name.
    """

    def add(build: Callable) -> Callable:
        @STEPS.register(*names)
        def step(df: DataFrame, context: StepContext, partition_by=None, order_by=None, options: dict | None = None) -> DataFrame:
            keys, order = names_of(partition_by), names_of(order_by)
            if not keys:
                raise ConfigurationError(f"{names[0]} needs partition_by: without it all rows would be one partition")
            given = options or {}
            more = T.StructType.fromDDL(adds(**given))
            kept = [f for f in df.schema.fields if f.name not in more.names]
            ship_package(df.sparkSession)
            inner = build(**given)

            class Rows:
                """Adds what the class yields to each of its rows."""

                def __init__(self):
                    self.inner = inner()

                def eval(self, row):
                    for made in self.inner.eval(row):
                        yield (*(row[f.name] for f in kept), *made)

                def terminate(self):
                    yield from ()

            function = F.udtf(Rows, returnType=T.StructType([*kept, *more.fields]))
            table = df.asTable().partitionBy(*(col(k) for k in keys))
            return function(table.orderBy(*(col(o) for o in order)) if order else table)

        step.__name__ = names[0]
        return build

    return add


@table_step("sessions", adds=lambda column, gap, name="session": f"{name} int")
def sessions(column: str, gap: float, name: str = "session") -> type:
    """Numbers from 0 that grow by one where ``column``, a moment, is more than ``gap`` seconds after the row before."""

    class Sessions:
        def __init__(self):
            self.last, self.number = None, 0

        def eval(self, row):
            now = row[column]
            if now is not None:
                if self.last is not None and (now - self.last).total_seconds() > gap:
                    self.number += 1
                self.last = now
            yield (self.number,)

    return Sessions


@table_step("fill_forward", adds=lambda column, kind: f"`{column}` {kind}")
def fill_forward(column: str, kind: str) -> type:
    """Nulls of ``column``, of type ``kind``, take the last value before them."""

    class FillForward:
        def __init__(self):
            self.last = None

        def eval(self, row):
            if row[column] is not None:
                self.last = row[column]
            yield (self.last,)

    return FillForward
