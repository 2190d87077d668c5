"""Steps that filter, join, group, order and deduplicate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import ORDINAL, arrival, as_text, col, names_of, number, replace
from tidemill.functions.expressions import compile_expression, failing, truthy
from tidemill.operators.aggregates import AGGREGATES
from tidemill.operators.base import STEPS, StepContext

#: Values of ``list`` and ``concat`` in one group at most; more is an error, not a cut.
MOST_LISTED = 10_000


@STEPS.register("filter", "where")
def filter_rows(df: DataFrame, context: StepContext, expression: str, invert: bool = False, on_error: str = "fail") -> DataFrame:
    """Rows for which an expression is true.

    Where it fails, as ``amount > 0`` does on null, the query fails, or with ``on_error: drop`` the
    row goes.  A condition that can't fail reaches the scan.
    """
    v = compile_expression(expression, df.schema, context.scope)
    wanted = ~truthy(v) if invert else truthy(v)
    if v.failed is None:
        plain = v.col if isinstance(v.kind, T.BooleanType) and not invert else wanted
        return df.where(plain)
    bad = failing(v)
    if on_error == "drop":
        return df.where(v.col & ~bad if isinstance(v.kind, T.BooleanType) and not invert else wanted & ~bad)
    if on_error != "fail":
        raise ConfigurationError("on_error is fail or drop")
    return df.where(F.when(bad, F.raise_error(F.lit(f"filter {expression!r} failed"))).otherwise(wanted))


@STEPS.register("limit", "head", "sample")
def limit(df: DataFrame, context: StepContext, count: int = 100, order_by=None) -> DataFrame:
    """The first rows in order of ``order_by`` or arrival."""
    if count <= 0:
        return df.where("false")
    if names_of(order_by) or ORDINAL in df.columns:
        return df.orderBy(*arrival(df, order_by)).limit(count)
    return df.limit(count)


@STEPS.register("join", "lookup_join", "enrich")
def join(df: DataFrame, context: StepContext, source, left_on, right_on=None, how: str = "left", columns=None, prefix: str = "", order_by=None) -> DataFrame:
    """Columns of the first matching row of another source.

    Keys match by equality, null with null, and rows never multiply.  Payload columns
    replace columns of the same name where there is a match.  ``source`` is a DataFrame or
    what the run's reader takes.  Spark broadcasts the other side by its measured size.
    """
    right = source if isinstance(source, DataFrame) else context.read(source)
    left_keys, right_keys = names_of(left_on), names_of(right_on) or names_of(left_on)
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ConfigurationError("join needs as many keys on the right as on the left")
    if how not in ("left", "inner", "semi", "anti"):
        raise ConfigurationError("how is left, inner, semi or anti")
    for a, b in zip(left_keys, right_keys):
        x, y = df.schema[a].dataType, right.schema[b].dataType
        numeric = isinstance(x, T.NumericType) and isinstance(y, T.NumericType)
        if not numeric and type(x) is not type(y):
            raise ConfigurationError(f"join: {a} is {x.simpleString()} but {b} is {y.simpleString()}; cast one of them")
    payload = [c for c in (names_of(columns) or right.columns) if c not in right_keys and c in right.columns]
    keys = [f"__k{i}" for i in range(len(left_keys))]
    values = [f"__v{i}" for i in range(len(payload))]
    order = F.struct(*(col(c) for c in names_of(order_by))) if names_of(order_by) else col(ORDINAL) if ORDINAL in right.columns else F.monotonically_increasing_id()
    match = [col(a).eqNullSafe(col(k)) for a, k in zip(left_keys, keys)]
    if how in ("semi", "anti"):
        return df.join(right.select(*(col(b).alias(k) for b, k in zip(right_keys, keys))), match, f"left_{how}")
    one = right.select(*(col(b).alias(k) for b, k in zip(right_keys, keys)), F.struct(*(col(c).alias(v) for c, v in zip(payload, values)), F.lit(True).alias("__hit")).alias("__row"), order.alias("__o"))
    one = one.groupBy(*keys).agg(F.min_by("__row", "__o").alias("__row"))
    both = df.join(one, match, how)
    hit = F.coalesce(F.col("__row.__hit"), F.lit(False))
    new = {prefix + c: F.col(f"__row.{v}") for c, v in zip(payload, values)}
    kept = [F.when(hit, new[c]).otherwise(col(c)).alias(c) if c in new else col(c) for c in df.columns]
    return both.select(*kept, *(v.alias(c) for c, v in new.items() if c not in df.columns))


def _listed(c, order, text: bool):
    """Non-null values in arrival order."""
    rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*order, c.alias("__v")))))
    values = F.transform(rows, lambda x: x["__v"])
    return F.array_join(values, ",") if text else values


@STEPS.register("aggregate", "group_by")
def aggregate(df: DataFrame, context: StepContext, aggregations: dict, group_by=None, order_by=None, max_groups: int | None = None) -> DataFrame:
    """One row for each group; null is a group.

    Functions: sum, avg, mean, count, count_distinct, min, max, first, last, list, concat, and
    those registered in :mod:`tidemill.operators.aggregates`.
    Sums are over what reads as a number, rounded to ten digits, and 0.0 for none.  ``first`` and
    ``last`` go by ``order_by`` or arrival and may be null.  Over no rows there is no group.
    """
    keys = names_of(group_by)
    order_names = names_of(order_by)
    held = df
    if not order_names and ORDINAL not in df.columns:
        held = df.withColumn(ORDINAL, F.monotonically_increasing_id())
    order = [col(c) for c in order_names] or [col(ORDINAL)]
    by = order[0] if len(order) == 1 else F.struct(*order)
    out, finals = [], {}
    for name, spec in aggregations.items():
        spec = {"function": spec} if isinstance(spec, str) else spec
        column, function = spec.get("column", name), spec.get("function", "sum")
        if column not in df.columns:
            raise ConfigurationError(f"aggregate: no column {column!r}")
        c, kind = col(column), df.schema[column].dataType
        if function == "sum":
            made = F.round(F.coalesce(F.sum(number(c, kind)), F.lit(0.0)), 10)
        elif function in ("avg", "mean"):
            made = F.round(F.avg(number(c, kind)), 10)
        elif function == "count":
            made = F.count(c)
        elif function == "count_distinct":
            made = F.count_distinct(as_text(c, kind))
        elif function in ("min", "max"):
            made = getattr(F, function)(c)
        elif function in ("first", "last"):
            pick = F.min_by if function == "first" else F.max_by
            made = pick(F.struct(c.alias("v")), by)["v"]
        elif function in ("list", "concat"):
            # counted before it is collected, so that no task holds more
            if not held.groupBy(*(col(k) for k in keys)).agg(F.count(c).alias("__n")).where(col("__n") > MOST_LISTED).isEmpty():
                raise ConfigurationError(f"{function} of {column!r}: more than {MOST_LISTED} values in one group")
            made = _listed(as_text(c, kind) if function == "concat" else c, [o.alias(f"__o{i}") for i, o in enumerate(order)], function == "concat")
        else:  # in two steps, its state and what follows from it
            found = AGGREGATES.get(function)
            made = found.partial(c, kind)
            finals[name] = found.final(col(name))
        out.append(made.alias(name))
    if not keys:
        return replace(held.agg(*out, F.count(F.lit(1)).alias("__n")).where(col("__n") > 0).drop("__n"), finals)
    grouped = replace(held.groupBy(*(col(k) for k in keys)).agg(*out), finals)
    if max_groups is not None and grouped.limit(max_groups + 1).count() > max_groups:
        raise ConfigurationError(f"aggregate makes more than {max_groups} groups")
    return grouped


def _sort_keys(columns, nulls_last: bool = True):
    keys = []
    for item in names_of(columns):
        name, _, direction = item.strip().rpartition(" ")
        if direction.lower() not in ("asc", "desc") or not name:
            name, direction = item.strip(), "asc"
        c = col(name.strip())
        # descending order turns the place of nulls around as well
        if direction.lower() == "desc":
            keys.append(c.desc_nulls_first() if nulls_last else c.desc_nulls_last())
        else:
            keys.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
    return keys


@STEPS.register("sort", "order_by")
def sort(df: DataFrame, context: StepContext, columns, nulls_last: bool = True) -> DataFrame:
    """Rows in order of ``column [desc]`` items; ties in arrival order if there is an ordinal."""
    more = [col(ORDINAL)] if ORDINAL in df.columns else []
    return df.orderBy(*_sort_keys(columns, nulls_last), *more)


@STEPS.register("deduplicate", "distinct", "dedupe")
def deduplicate(df: DataFrame, context: StepContext, columns=None, keep: str = "first", order_by=None) -> DataFrame:
    """One row for each key, the first or last by ``order_by`` and arrival; null equals null.

    Spark keeps only each partition's first row of a key before the shuffle, so a key with very
    many rows costs no more than others.
    """
    if keep not in ("first", "last"):
        raise ConfigurationError("keep is first or last")
    keys = names_of(columns)
    if not keys and not names_of(order_by):
        shown = [c for c in df.columns if c != ORDINAL]
        return df.dropDuplicates(shown)
    keys = keys or [c for c in df.columns if c != ORDINAL]
    held = df.withColumn("__at", col(ORDINAL) if ORDINAL in df.columns else F.monotonically_increasing_id())
    order = [*_sort_keys(order_by), col("__at").asc()]
    if keep == "last":
        order = [*_turned(order_by), col("__at").desc()]
    best = Window.partitionBy(*(col(k) for k in keys)).orderBy(*order)
    return held.withColumn("__n", F.row_number().over(best)).where(col("__n") == 1).drop("__n", "__at")


def _turned(order_by):
    """Sort keys from the other end."""
    keys = []
    for item in names_of(order_by):
        name, _, direction = item.strip().rpartition(" ")
        if direction.lower() not in ("asc", "desc") or not name:
            name, direction = item.strip(), "asc"
        c = col(name.strip())
        keys.append(c.asc_nulls_last() if direction.lower() == "desc" else c.desc_nulls_first())
    return keys


@STEPS.register("dedupe_batch", "deduplicate_batch")
def dedupe_batch(df: DataFrame, context: StepContext, columns=None, order_by=None) -> DataFrame:
    """The first row of each key within each batch of ``batch_size`` rows in arrival order."""
    from tidemill.operators.shape import numbered

    keys = names_of(columns) or [c for c in df.columns if c != ORDINAL]
    held = numbered(df, "__at", order_by).withColumn("__batch", F.floor(col("__at") / context.batch_size))
    first = Window.partitionBy(col("__batch"), *(col(k) for k in keys)).orderBy("__at")
    return held.withColumn("__n", F.row_number().over(first)).where(col("__n") == 1).drop("__n", "__at", "__batch")
