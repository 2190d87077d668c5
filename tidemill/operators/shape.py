"""Steps that change which columns there are and what they are called."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import ORDINAL, arrival, col, names_of, replace
from tidemill.operators.base import STEPS, StepContext


def _renamed(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Columns under new names; of equal new names the last one's value wins, at the first one's place."""
    last = {new: old for old, new in pairs}
    return df.select(*(col(last[new]).alias(new) for new in dict.fromkeys(new for _, new in pairs)))


@STEPS.register("rename", "rename_columns")
def rename(df: DataFrame, context: StepContext, mapping: dict, strict: bool = False) -> DataFrame:
    """New names for columns, all at once; a missing one is an error only if ``strict``."""
    missing = [c for c in mapping if c not in df.columns]
    if strict and missing:
        raise ConfigurationError(f"rename: no column {', '.join(missing)}")
    return _renamed(df, [(c, mapping.get(c, c)) for c in df.columns])


@STEPS.register("drop", "drop_columns")
def drop(df: DataFrame, context: StepContext, columns) -> DataFrame:
    """Without these columns; missing ones don't matter."""
    gone = set(names_of(columns))
    return df.select(*(col(c) for c in df.columns if c not in gone))


@STEPS.register("select", "select_columns", "project")
def select(df: DataFrame, context: StepContext, columns, fill_missing: bool = True) -> DataFrame:
    """These columns in this order; missing ones are null, or left out."""
    wanted = names_of(columns)
    return df.select(*(col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted if fill_missing or c in df.columns))


def tidy_name(name: str, case: str = "snake", strip_accents: bool = True) -> str:
    """A column name in plain form."""
    if strip_accents:
        name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    if case == "snake":
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    name = re.sub(r"[^0-9A-Za-z]+" if strip_accents else r"\W+", "_", name).strip("_")
    name = name.upper() if case == "upper" else name.lower()
    return name or "column"


@STEPS.register("normalize_columns", "clean_column_names")
def normalize_columns(df: DataFrame, context: StepContext, case: str = "snake", strip_accents: bool = True) -> DataFrame:
    """All names in snake, lower or upper case, with nothing but letters, digits and ``_``."""
    if case not in ("snake", "lower", "upper"):
        raise ConfigurationError("case is snake, lower or upper")
    return _renamed(df, [(c, tidy_name(c, case, strip_accents)) for c in df.columns])


@STEPS.register("add_column", "constant")
def add_column(df: DataFrame, context: StepContext, column: str, value=None, overwrite: bool = True) -> DataFrame:
    """A constant column.  Texts may hold ``${execution_id}`` and the like; ``${now}`` is the query's time."""
    if column in df.columns and not overwrite:
        return df
    if not isinstance(value, str) or "${" not in value:
        made = F.lit(None).cast("string") if value is None else F.to_json(F.lit(value)) if isinstance(value, dict) else F.lit(value)
        return replace(df, {column: made})
    parts = re.split(r"\$\{(\w+)\}", value)
    known = {k: F.lit(getattr(context, k)) for k in ("execution_id", "pipeline_id", "task_id", "correlation_id")}
    known["now"] = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    made = [known.get(p, F.lit("${" + p + "}")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return replace(df, {column: F.concat(*made)})


@STEPS.register("split_column")
def split_column(df: DataFrame, context: StepContext, column: str, into, separator: str = " ", keep_original: bool = False) -> DataFrame:
    """Parts of a text at a literal separator, trimmed; the last part keeps the rest, missing parts are null."""
    if not separator:
        raise ConfigurationError("split_column needs a separator")
    targets = names_of(into)
    parts = F.split(col(column).cast("string"), "\\Q" + separator + "\\E", len(targets))
    trimmed = lambda i: F.regexp_replace(F.try_element_at(parts, F.lit(i + 1)), r"(?U)^\s+|\s+\z", "")
    out = replace(df, {t: trimmed(i) for i, t in enumerate(targets)})
    return out if keep_original or column in targets else out.select(*(col(c) for c in out.columns if c != column))


def _leaves(name: str, kind: T.DataType, value, separator: str, depth: int, keep_lists: bool, sizes: dict):
    if isinstance(kind, T.StructType) and depth > 0:
        if not kind.fields:
            yield name, F.lit(None).cast("string")
        for f in kind.fields:
            yield from _leaves(f"{name}{separator}{f.name}", f.dataType, value.getField(f.name), separator, depth - 1, keep_lists, sizes)
    elif isinstance(kind, T.ArrayType) and not keep_lists and depth > 0 and name in sizes:
        for i in range(sizes[name]):
            yield from _leaves(f"{name}{separator}{i}", kind.elementType, F.try_element_at(value, F.lit(i + 1)), separator, depth - 1, keep_lists, sizes)
    else:
        yield name, value


#: Keys of a map that become columns; further ones stay in the map.
MOST_KEYS = 4096


@STEPS.register("flatten", "flatten_json")
def flatten(df: DataFrame, context: StepContext, separator: str = ".", max_depth: int = 5, columns=None, keep_lists: bool = True) -> DataFrame:
    """Nested columns as columns of their own, ``max_depth`` levels down.

    Structs unfold by their schema.  Maps, and lists unless ``keep_lists``, need one pass over
    the data for their keys and sizes.  Of a map with more than ``MOST_KEYS`` different keys the
    first ones by name become columns, and a map with the others stays, so nothing is lost.
    """
    wanted = names_of(columns) or df.columns
    maps = [c for c in wanted if c in df.columns and isinstance(df.schema[c].dataType, T.MapType)]
    for c in maps:
        keys = [r[0] for r in df.select(F.explode(F.map_keys(col(c))).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()]
        made = F.struct(*(F.try_element_at(col(c), F.lit(k)).alias(str(k)) for k in keys[:MOST_KEYS])) if keys else F.lit(None).cast("string")
        if len(keys) > MOST_KEYS:
            rest = f"{c}{separator}rest"
            while rest in df.columns:
                rest += "_"
            df = replace(df, {rest: F.map_filter(col(c), lambda k, _: k > F.lit(keys[MOST_KEYS - 1]))})
        df = replace(df, {c: made})
    sizes: dict[str, int] = {}
    if not keep_lists:
        lists = [c for c in wanted if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
        if lists:
            row = df.agg(*(F.max(F.size(col(c))).alias(f"n{i}") for i, c in enumerate(lists))).first()
            sizes = {c: max(row[f"n{i}"] or 0, 0) for i, c in enumerate(lists)}
    out = []
    for f in df.schema.fields:
        if f.name in wanted:
            out += [v.alias(n) for n, v in _leaves(f.name, f.dataType, col(f.name), separator, max_depth, keep_lists, sizes)]
        else:
            out.append(col(f.name))
    return df.select(*out)


@STEPS.register("add_metadata", "lineage")
def add_metadata(df: DataFrame, context: StepContext, prefix: str = "_", include=None, order_by=None) -> DataFrame:
    """Columns that say where rows come from.

    ``row_number`` and ``batch`` number the rows by ``order_by`` or arrival.  Numbers come from
    sizes of range partitions and positions inside them, so no task sees all rows.
    """
    wanted = names_of(include) or ["execution_id", "pipeline_id", "loaded_at"]
    new = {}
    if {"row_number", "batch"} & set(wanted):
        df = numbered(df, "__n", order_by)
    for what in wanted:
        if what == "loaded_at":
            made = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        elif what == "row_number":
            made = col("__n") + 1
        elif what == "batch":
            made = F.floor(col("__n") / context.batch_size).cast("long")
        elif what in ("execution_id", "pipeline_id", "task_id", "correlation_id", "source"):
            made = F.lit(getattr(context, what))
        else:
            raise ConfigurationError(f"add_metadata has no {what!r}")
        new[prefix + what] = made
    out = replace(df, new)
    return out.drop("__n") if "__n" in out.columns else out


def numbered(df: DataFrame, name: str, order_by=None) -> DataFrame:
    """``df`` with a column of consecutive numbers from 0 in order of ``order_by`` or arrival.

    Rows are range-partitioned and sorted in parallel; the partitions' sizes, one row each,
    give the offsets.
    """
    from tidemill.plans.staging import staged

    if not names_of(order_by) and ORDINAL not in df.columns:
        df = staged(df.withColumn(ORDINAL, F.monotonically_increasing_id()))
        return numbered(df, name, ORDINAL).drop(ORDINAL)
    keys = arrival(df, order_by)
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = staged(ordered.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id() % (1 << 33)}))
    sizes = {r["__p"]: r["n"] for r in held.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, cases = 0, []
    for p in sorted(sizes):
        cases += [F.lit(p), F.lit(offset)]
        offset += sizes[p]
    start = F.element_at(F.create_map(*cases), col("__p")) if cases else F.lit(0)
    return held.withColumn(name, (start + col("__i")).cast("long")).drop("__p", "__i")
