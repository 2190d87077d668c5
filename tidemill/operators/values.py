"""Steps that compute and clean values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import as_text, blank, col, is_text, iso_text, names_of, number, parse_moment, replace, strip, title_case, without_accents
from tidemill.functions.expressions import compile_expression, failing
from tidemill.operators.base import STEPS, StepContext


@STEPS.register("derive", "calculate", "computed_column")
def derive(df: DataFrame, context: StepContext, column: str, expression: str, on_error: str = "null") -> DataFrame:
    """A column from an expression.  Where it fails: null, an error, or the column as it was."""
    v = compile_expression(expression, df.schema, context.scope)
    bad = failing(v)
    if on_error == "fail":
        made = F.when(bad, F.raise_error(F.lit(f"derive {column}: {expression!r} failed"))).otherwise(v.col)
    elif on_error == "keep":
        old = col(column) if column in df.columns else F.lit(None)
        same = column in df.columns and df.schema[column].dataType != v.kind and not isinstance(v.kind, T.NullType)
        made = F.when(~bad, as_text(v.col, v.kind) if same else v.col).otherwise(old.cast("string") if same else old)
    elif on_error == "null":
        made = F.when(~bad, v.col) if v.failed is not None else v.col
    else:
        raise ConfigurationError("on_error is null, fail or keep")
    return replace(df, {column: made.cast("string") if isinstance(v.kind, T.NullType) else made})


#: What text counts as true and as false.
TRUE_WORDS = ("true", "t", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "f", "no", "n", "0", "off")


def converted(c, kind: T.DataType, target: str, pattern: str | None = None):
    """A value as another logical type, or null."""
    text = strip(as_text(c, kind))
    if target in ("string", "str", "text"):
        return as_text(c, kind)
    if target in ("integer", "int", "long"):
        x = c.cast("int").cast("double") if isinstance(kind, T.BooleanType) else number(c, kind)
        exact = F.regexp_replace(text, ",", "").try_cast("long") if isinstance(kind, T.StringType) else None
        whole = F.when(F.abs(x) < 9.2e18, x).cast("long")
        return c if isinstance(kind, T.LongType) else whole if exact is None else F.coalesce(exact, whole)
    if target in ("float", "double", "number"):
        return c.cast("double") if isinstance(kind, T.BooleanType) else number(c, kind)
    if target == "decimal":
        return F.regexp_replace(text, ",", "").try_cast("decimal(38,18)")
    if target in ("boolean", "bool"):
        if isinstance(kind, T.BooleanType):
            return c
        if isinstance(kind, T.NumericType):
            return c != 0
        low = F.lower(text)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if target == "date":
        return F.date_format(parse_moment(c, kind, pattern), "yyyy-MM-dd")
    if target in ("datetime", "timestamp"):
        return iso_text(parse_moment(c, kind, pattern))
    if target == "json":
        return F.try_parse_json(text) if isinstance(kind, T.StringType) else c
    raise ConfigurationError(f"unknown type {target!r}")


@STEPS.register("cast", "convert_types", "astype")
def cast(df: DataFrame, context: StepContext, columns: dict, on_error: str = "null", date_format: str | None = None) -> DataFrame:
    """Columns as other types.  Values that don't convert: null, an error, or kept (then the column is text)."""
    new = {}
    for name, target in columns.items():
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        made = converted(col(name), kind, target, date_format)
        lost = made.isNull() & col(name).isNotNull()
        if on_error == "fail":
            made = F.when(lost, F.raise_error(F.concat(F.lit(f"cast {name} to {target}: "), F.coalesce(as_text(col(name), kind), F.lit(""))))).otherwise(made)
        elif on_error == "keep":
            made = F.when(lost, as_text(col(name), kind)).otherwise(made.cast("string"))
        new[name] = made
    return replace(df, new)


@STEPS.register("fill_null", "fillna", "default_value")
def fill_null(df: DataFrame, context: StepContext, columns=None, value=None, treat_empty_as_null: bool = True) -> DataFrame:
    """Defaults for null (and blank) values; a column that is missing is made."""
    defaults = dict(columns) if isinstance(columns, dict) else dict.fromkeys(names_of(columns), value)
    new = {}
    for name, default in defaults.items():
        if name not in df.columns:
            new[name] = F.lit(default)
            continue
        c, kind = col(name), df.schema[name].dataType
        empty = blank(c) if treat_empty_as_null and is_text(df, name) else c.isNull()
        fits = isinstance(kind, T.StringType) or not isinstance(default, str)
        filled = F.lit(str(default) if isinstance(kind, T.StringType) and default is not None else default)
        new[name] = F.when(empty, filled.cast(kind) if fits else filled).otherwise(c if fits else as_text(c, kind))
    return replace(df, new)


@STEPS.register("map_values", "replace_values", "lookup")
def map_values(df: DataFrame, context: StepContext, column: str, mapping: dict, default=None, keep_unmapped: bool = True, target: str | None = None) -> DataFrame:
    """Values replaced by a table keyed on their text; null is looked up as "None"."""
    if column not in df.columns:
        return df
    kind = df.schema[column].dataType
    key = F.coalesce(as_text(col(column), kind), F.lit("None"))
    results = [*mapping.values(), *([default] if default is not None else [])]
    same = {type(r) for r in results if r is not None}
    text = len(same) != 1 or (keep_unmapped and default is None)
    kept_as_is = text and same == {str} and isinstance(kind, T.StringType)
    lit = lambda v: F.lit(None if v is None else str(v) if text else v)
    made = F.lit(None)
    if mapping:
        table = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(str(k)), lit(v))))
        made = F.try_element_at(table, key)
        known = F.map_contains_key(table, key)
    else:
        known = F.lit(False)
    other = lit(default) if default is not None or not keep_unmapped else (col(column) if kept_as_is else as_text(col(column), kind))
    return replace(df, {target or column: F.when(known, made).otherwise(other)})


_TEXT_OPERATIONS = {
    "trim": strip,
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**30))),
    "collapse_spaces": lambda c: strip(F.regexp_replace(c, r"(?U)\s+", " ")),
    "remove_accents": without_accents,
    "digits_only": lambda c: F.regexp_replace(c, r"\D", ""),
    "alnum_only": lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", ""),
}


@STEPS.register("string_ops", "text")
def string_ops(df: DataFrame, context: StepContext, columns, operations=("trim",), max_length: int = 0) -> DataFrame:
    """Text operations in order, then a cut at ``max_length`` characters."""
    new = {}
    for name in names_of(columns):
        if name not in df.columns:
            continue
        c = as_text(col(name), df.schema[name].dataType)
        for operation in names_of(operations):
            if operation not in _TEXT_OPERATIONS:
                raise ConfigurationError(f"unknown text operation {operation!r}")
            c = _TEXT_OPERATIONS[operation](c)
        new[name] = F.substring(c, 1, max_length) if max_length > 0 else c
    return replace(df, new)


@STEPS.register("concat_columns", "combine")
def concat_columns(df: DataFrame, context: StepContext, columns, target: str, separator: str = " ", skip_null: bool = True) -> DataFrame:
    """Texts joined.  Nulls and blanks are skipped, or nulls are written as ``None``."""
    parts = []
    for name in names_of(columns):
        c = as_text(col(name), df.schema[name].dataType) if name in df.columns else F.lit(None).cast("string")
        parts.append(F.when(~blank(c), c) if skip_null else F.coalesce(c, F.lit("None")))
    return replace(df, {target: F.concat_ws(separator, *parts)})


@STEPS.register("convert_currency", "currency")
def convert_currency(df: DataFrame, context: StepContext, columns, rates: dict, currency_column: str | None = None, from_: str | None = None, target_column_suffix: str = "", precision: int = 2) -> DataFrame:
    """Amounts times the rate of their currency, rounded half to even on decimals.

    Rows of an unknown currency, and cells that are no numbers, stay as they are.
    """
    table = F.create_map(*(x for k, v in rates.items() for x in (F.lit(str(k).upper()), F.lit(str(v)).cast("decimal(20,10)"))))
    code = F.upper(F.trim(col(currency_column).cast("string"))) if currency_column else F.lit((from_ or "").upper())
    rate = F.try_element_at(table, code)
    new = {}
    for name in names_of(columns):
        c, kind = col(name), df.schema[name].dataType
        amount = F.regexp_replace(as_text(c, kind), ",", "").try_cast("decimal(18,8)")
        money = F.bround(amount * rate, precision).cast("double")
        target = name + target_column_suffix
        numeric = isinstance(kind, T.NumericType)
        if target != name:
            new[target] = money
        else:
            new[target] = F.when(money.isNotNull(), money).otherwise(c.cast("double")) if numeric else F.coalesce(as_text(money, T.DoubleType()), c.cast("string"))
    return replace(df, new)
