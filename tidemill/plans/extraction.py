"""Incremental extraction, change capture and schema drift."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError, SchemaDriftError
from tidemill.functions.columns import arrival, as_text, col, names_of


def rewound(mark, overlap: float):
    """A mark some seconds earlier; only moments can be moved."""
    if not overlap or mark is None:
        return mark
    if isinstance(mark, str):
        try:
            moment = datetime.datetime.fromisoformat(mark)
        except ValueError:
            return mark
        moved = moment - datetime.timedelta(seconds=overlap)
        return moved.date().isoformat() if len(mark) == 10 and moved.time() == datetime.time() else moved.isoformat()
    return mark - datetime.timedelta(seconds=overlap) if isinstance(mark, datetime.datetime) else mark


def since(df: DataFrame, column: str, mark, overlap: float = 0) -> DataFrame:
    """Rows beyond a mark; the comparison reaches the scan.  Without a mark, all rows."""
    if column not in df.columns:
        raise ConfigurationError(f"no column {column!r} to extract by")
    if mark is None:
        return df
    kind = df.schema[column].dataType
    return df.where(col(column) > F.lit(rewound(mark, overlap)).cast(kind))


def highest(df: DataFrame, column: str):
    """The greatest value of a column, as JSON can hold it."""
    top = df.agg(F.max(col(column)).alias("m"))
    kind = df.schema[column].dataType
    value = top.select(as_text(F.col("m"), kind).alias("m") if not isinstance(kind, T.NumericType) else F.col("m")).first()["m"]
    return float(value) if isinstance(kind, T.DecimalType) and value is not None else value


def later_mark(old, new):
    """The mark to keep; it never moves back."""
    return new if old is None else old if new is None else max(old, new)


def first_changes(df: DataFrame, key_columns, order_by=None) -> DataFrame:
    """The first row delivered of each key (as text)."""
    keys = [as_text(col(c), df.schema[c].dataType) for c in names_of(key_columns)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*arrival(df, order_by)))
    return df.withColumn("__n", place).where(col("__n") == 1).drop("__n")


def described(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def drift(old: dict[str, str] | None, new: dict[str, str]) -> dict[str, list[str]]:
    """Columns added, removed and of another type since ``old``; nothing is drift the first time."""
    if old is None:
        return {"added": [], "removed": [], "changed": []}
    return {
        "added": sorted(set(new) - set(old)),
        "removed": sorted(set(old) - set(new)),
        "changed": sorted(c for c in set(old) & set(new) if old[c] != new[c]),
    }


def check_drift(found: dict[str, list[str]], policy: str = "additive") -> None:
    """``strict`` allows no change, ``additive`` new columns, ``permissive`` anything."""
    if policy not in ("strict", "additive", "permissive"):
        raise ConfigurationError("drift policy is strict, additive or permissive")
    bad = {k: v for k, v in found.items() if v and (policy == "strict" or (policy == "additive" and k != "added"))}
    if bad:
        raise SchemaDriftError(f"the source changed: {bad}")


