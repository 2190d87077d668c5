"""Column functions that several operators use."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError

#: The column that holds arrival order, if a step or source has made one.
ORDINAL = "_ordinal"


def quoted(name: str) -> str:
    """A name as Spark takes it literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def names_of(value) -> list[str]:
    """A list option, which may be one comma-separated string."""
    if value is None:
        return []
    return [v.strip() for v in value.split(",") if v.strip()] if isinstance(value, str) else list(value)


def arrival(df: DataFrame, order_by=None) -> list[Column]:
    """Sort keys for arrival order: the given columns, an ordinal column, or the order of the scan."""
    given = names_of(order_by)
    if given:
        return [col(c).asc_nulls_last() for c in given]
    return [col(ORDINAL).asc()] if ORDINAL in df.columns else [F.monotonically_increasing_id().asc()]


def replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with columns set in one projection; names are taken literally and keep their place."""
    kept = [new.get(c, col(c)).alias(c) if c in new else col(c) for c in df.columns]
    return df.select(*kept, *(v.alias(c) for c, v in new.items() if c not in df.columns))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def blank(c: Column) -> Column:
    """Null, or text of white space only."""
    return c.isNull() | (strip(c.cast("string")) == "")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def as_text(c: Column, kind: T.DataType) -> Column:
    """The text of a value as Python writes it: True, 1.5, 3.0; nested values as JSON."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        short = c.cast("string")
        whole = F.when((F.abs(c) < 1e16) & (c == F.floor(c)), F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0")))
        # Spark writes exponents from 1e7 on, Python from 1e16 on
        mid = F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), F.regexp_replace(c.cast("decimal(38,16)").cast("string"), "0+$", ""))
        exponent = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(short, r"\.0E", "E")), "e([0-9])", "e+$1"), r"e([+-])(\d)$", "e$10$2")
        special = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        return F.when(c.isNotNull(), F.coalesce(special, whole, mid, F.when(short.contains("E"), exponent), short))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def number(c: Column, kind: T.DataType) -> Column:
    """A double, or null: text may have thousands separators, booleans are no numbers."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    return F.regexp_replace(strip(c), ",|(?<=\\d)_(?=\\d)", "").try_cast("double")


@F.pandas_udf(T.StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    """Letters without their combining marks."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


@F.pandas_udf(T.StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """A capital after each character that is no letter."""
    return texts.map(lambda t: t.title(), na_action="ignore")


_DATE_LETTERS = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE",
    "a": "EEE", "I": "hh", "p": "a", "j": "DDD", "f": "SSSSSS", "z": "xx", "Z": "z", "%": "%", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
}


def date_pattern(strftime: str) -> str:
    """A strftime pattern in Spark's letters."""
    out, text, i = [], "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%":
            letter = strftime[i + 1 : i + 2]
            if letter not in _DATE_LETTERS:
                raise ConfigurationError(f"date pattern %{letter} isn't supported")
            if text:
                out.append("'" + text.replace("'", "''") + "'")
                text = ""
            out.append(_DATE_LETTERS[letter])
            i += 2
            continue
        if c.isalpha() or c == "'":
            text += c
        else:
            if text:
                out.append("'" + text.replace("'", "''") + "'")
                text = ""
            out.append(c)
        i += 1
    return "".join(out) + ("'" + text.replace("'", "''") + "'" if text else "")


#: The formats that dates are tried in after ISO, in this order.
FALLBACK_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y%m%d")


def parse_moment(c: Column, kind: T.DataType, pattern: str | None = None) -> Column:
    """A timestamp without zone, or null; an offset in the text is kept as wall-clock time."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    text = strip(c.cast("string"))
    if pattern:
        return F.try_to_timestamp(text, F.lit(date_pattern(pattern))).cast("timestamp_ntz")
    iso = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    iso = F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"), iso.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(date_pattern(p))).cast("timestamp_ntz") for p in FALLBACK_FORMATS))


def iso_text(c: Column) -> Column:
    """ISO text of a timestamp; the fraction only if there is one."""
    seconds = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), fraction))
