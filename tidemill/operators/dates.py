"""Steps on dates and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import as_text, blank, col, date_pattern, iso_text, names_of, parse_moment, replace, strip
from tidemill.operators.base import STEPS, StepContext


@STEPS.register("parse_date", "date_parse")
def parse_date(df: DataFrame, context: StepContext, columns, format: str | None = None, output_format: str | None = None, on_error: str = "null") -> DataFrame:
    """Texts in any known date format as ISO text, or in ``output_format``."""
    new = {}
    for name in names_of(columns):
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        moment = parse_moment(col(name), kind, format)
        made = F.date_format(moment, date_pattern(output_format)) if output_format else iso_text(moment)
        lost = made.isNull() & ~blank(col(name))
        if on_error == "fail":
            made = F.when(lost, F.raise_error(F.concat(F.lit(f"parse_date {name}: "), as_text(col(name), kind)))).otherwise(made)
        elif on_error == "keep":
            made = F.when(lost, as_text(col(name), kind)).otherwise(made)
        new[name] = made
    return replace(df, new)


def _zone(name: str) -> str:
    if name.upper() in ("UTC", "Z"):
        return "UTC"
    return name


@STEPS.register("convert_timezone", "timezone")
def convert_timezone(df: DataFrame, context: StepContext, columns, from_: str = "UTC", to: str = "UTC") -> DataFrame:
    """Times moved to another zone, as ISO text with offset.

    A time with an offset of its own keeps that instant; others are in zone ``from``.  What
    is no time stays as it is.
    """
    if not isinstance(from_, str) or not isinstance(to, str):
        raise ConfigurationError("zones are names or offsets")
    new = {}
    for name in names_of(columns):
        if name not in df.columns:
            continue
        text = strip(as_text(col(name), df.schema[name].dataType))
        own = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
        has_offset = text.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
        offset = F.when(own == "Z", "+00:00").when(F.length(own) == 5, F.concat(F.substring(own, 1, 3), F.lit(":"), F.substring(own, 4, 2))).otherwise(own)
        wall = parse_moment(col(name), df.schema[name].dataType)
        zone = F.when(has_offset, offset).otherwise(F.lit(_zone(from_)))
        moved = F.convert_timezone(zone, F.lit(_zone(to)), wall)
        # the offset of the target zone is how far its wall clock is from UTC's
        utc = F.convert_timezone(zone, F.lit("UTC"), wall)
        minutes = F.round((F.unix_micros(moved.cast("timestamp")) - F.unix_micros(utc.cast("timestamp"))) / 60_000_000).cast("int")
        shown = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
        new[name] = F.when(wall.isNotNull(), F.concat(iso_text(moved), shown)).otherwise(as_text(col(name), df.schema[name].dataType))
    return replace(df, new)
