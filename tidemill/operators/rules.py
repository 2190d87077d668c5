"""Validation rules and what happens to rows that break them.

A rule compiles to a column that is the message of a violation, or null.  Rows carry all their
violations in one array, so rows are read once; policies split on that array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError, ValidationError
from tidemill.functions.columns import ORDINAL, as_text, blank, col, names_of, number, parse_moment
from tidemill.functions.expressions import compile_expression, failing, truthy
from tidemill.operators.values import converted
from tidemill.registry import Registry

RULES = Registry("rule")

#: What counts as an e-mail address and as a UUID.
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"

#: Rows that must have been checked before a rate of errors means anything.
RATE_NEEDS = 100
MOST_SAMPLES = 50


@dataclass
class Check:
    """What a rule sees: the table and its options."""

    df: DataFrame
    options: dict

    def field(self) -> tuple[Column, T.DataType]:
        name = self.options.get("field")
        if not name:
            raise ConfigurationError(f"rule {self.options.get('type')!r} needs a field")
        if name not in self.df.columns:
            return F.lit(None).cast("string"), T.StringType()
        return col(name), self.df.schema[name].dataType

    def get(self, name: str, default=None):
        return self.options.get(name, default)


def _message(when: Column, text) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), text if isinstance(text, Column) else F.lit(text))


@RULES.register("not_null", "required")
def not_null(check: Check) -> list[Column]:
    c, kind = check.field()
    bad = c.isNull() if check.get("allow_empty_string", False) or not isinstance(kind, T.StringType) else blank(c)
    return [_message(bad, "value is required")]


@RULES.register("required_columns", "schema_columns")
def required_columns(check: Check) -> list[Column]:
    missing = [c for c in names_of(check.get("columns")) if c not in check.df.columns]
    return [F.lit(f"missing column {c}") for c in missing]


@RULES.register("type", "data_type")
def data_type(check: Check) -> list[Column]:
    c, kind = check.field()
    expected = check.get("expected")
    if check.get("strict", False) and isinstance(kind, T.StringType) and expected in ("string", "boolean", "integer", "float"):
        return [_message(c.isNotNull(), f"not a {expected}") if expected != "string" else F.lit(None).cast("string")]
    if expected in ("integer", "float") and isinstance(kind, T.BooleanType):
        return [_message(c.isNotNull(), f"not a {expected}")]
    made = converted(c, kind, expected)
    bad = c.isNotNull() & made.isNull()
    if expected == "integer":
        x = number(c, kind)
        bad = c.isNotNull() & (x.isNull() | F.coalesce(x != F.floor(x), F.lit(True)))
    if expected == "boolean" and isinstance(kind, T.NumericType):
        bad = c.isNotNull() & ~c.isin(0, 1)
    return [_message(bad, f"not a {expected}")]


@RULES.register("range", "between")
def in_range(check: Check) -> list[Column]:
    c, kind = check.field()
    x = number(c, kind)
    out = [_message(c.isNotNull() & x.isNull(), "not a number")]
    fine = x.isNotNull() & ~F.isnan(x)
    low, high, exclusive = check.get("min"), check.get("max"), check.get("exclusive", False)
    if low is not None:
        out.append(_message(fine & (x <= low if exclusive else x < low), f"below {low}"))
    if high is not None:
        out.append(_message(fine & (x >= high if exclusive else x > high), f"above {high}"))
    return out


@RULES.register("length")
def text_length(check: Check) -> list[Column]:
    c, kind = check.field()
    n = F.length(as_text(c, kind))
    if check.get("exact") is not None:
        return [_message(n != check.get("exact"), f"length is not {check.get('exact')}")]
    out = []
    if check.get("min") is not None:
        out.append(_message(n < check.get("min"), f"shorter than {check.get('min')}"))
    if check.get("max") is not None:
        out.append(_message(n > check.get("max"), f"longer than {check.get('max')}"))
    return out


@RULES.register("regex", "pattern", "matches")
def regex(check: Check) -> list[Column]:
    c, kind = check.field()
    pattern = check.get("pattern").replace("(?P<", "(?<").replace(r"\Z", r"\z")
    pattern = ("(?i)" if check.get("ignore_case", False) else "") + (rf"^(?:{pattern})\z" if check.get("full_match", True) else pattern)
    return [_message(~as_text(c, kind).rlike(pattern), "doesn't match the pattern")]


def _matching(name: str, pattern: str, what: str):
    @RULES.register(name)
    def rule(check: Check) -> list[Column]:
        c, kind = check.field()
        return [_message(~blank(c) & ~as_text(c, kind).rlike(pattern), f"not {what}")]


_matching("email", EMAIL, "an e-mail address")
_matching("uuid", UUID, "a UUID")


@RULES.register("date_format")
def date_rule(check: Check) -> list[Column]:
    c, kind = check.field()
    moment = parse_moment(c, kind, check.get("format"))
    out = [_message(~blank(c) & moment.isNull(), "not a date in the format")]
    for name, bad in (("min_date", lambda x, y: x < y), ("max_date", lambda x, y: x > y)):
        if check.get(name) is not None:
            bound = parse_moment(F.lit(str(check.get(name))), T.StringType())
            out.append(_message(bad(moment, bound), f"{'before' if name[1] == 'i' else 'after'} {check.get(name)}"))
    return out


@RULES.register("in_set", "allowed_values", "enum")
def in_set(check: Check) -> list[Column]:
    c, kind = check.field()
    values = [str(v) for v in check.get("values", [])]
    text = as_text(c, kind)
    if not check.get("case_sensitive", True):
        text, values = F.lower(text), [v.lower() for v in values]
    return [_message(~text.isin(*values) if values else c.isNotNull(), "not an allowed value")]


@RULES.register("unique", "distinct")
def unique(check: Check) -> list[Column]:
    """Later rows of a key that an earlier one has, by ``order_by`` or arrival; null is a value."""
    return [_message(col(_repeat_name(check.options)), "value is not unique")]


def _repeat_name(spec: dict) -> str:
    return "__repeats_" + "_".join([*(names_of(spec.get("columns")) or [str(spec.get("field"))]), "by", *names_of(spec.get("order_by"))])


def with_repeats(df: DataFrame, keys: list[str], order_by, name: str, salts: int = 64) -> DataFrame:
    """``df`` with a flag for later rows of a key.

    Rows of a key are first compared in ``salts`` groups of their own, then the first of
    each, so a key with very many rows doesn't meet in one task.
    """
    order = [col(c) for c in names_of(order_by)] or [col(ORDINAL)]
    by = [col(k) for k in keys]
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    held = df.withColumn("__salt", salt).withColumn("__n", F.row_number().over(Window.partitionBy(*by, col("__salt")).orderBy(*order)))
    # the first rows of all salts meet in one small group, the others stay where they are
    group = F.when(col("__n") > 1, col("__salt")).otherwise(F.lit(-1))
    place = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
    return held.withColumn(name, (col("__n") > 1) | (place > 1)).drop("__salt", "__n")


@RULES.register("sequence", "monotonic")
def sequence(check: Check) -> list[Column]:
    """Values below (strict: or equal to) the greatest value before them, by ``order_by`` or arrival."""
    c, kind = check.field()
    before = col(f"__before_{check.get('field')}")
    return [_message(c < before if not check.get("strict", False) else c <= before, "value is out of order")]


@RULES.register("expression", "business_rule", "custom")
def expression(check: Check) -> list[Column]:
    v = compile_expression(check.get("expression"), check.df.schema, {"params": {}, "state": {}})
    return [_message(~truthy(v) & ~failing(v), f"{check.get('expression')} doesn't hold")]


@RULES.register("comparison", "field_comparison")
def comparison(check: Check) -> list[Column]:
    left, right, op = check.get("left") or check.get("field"), check.get("right"), check.get("operator", "<=")
    a, b = col(left), col(right)
    x, y = check.df.schema[left].dataType, check.df.schema[right].dataType
    if isinstance(x, T.NumericType) != isinstance(y, T.NumericType):
        a, b = as_text(a, x), as_text(b, y)
    holds = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}
    if op not in holds:
        raise ConfigurationError(f"unknown comparison {op!r}")
    return [_message(~holds[op], f"{left} {op} {right} doesn't hold")]


def expand_schema(schema: dict) -> list[dict]:
    """The rules that a schema block stands for."""
    out = [{"type": "required_columns", "columns": list(schema)}]
    for name, spec in schema.items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        if spec.get("type"):
            out.append({"type": "type", "field": name, "expected": spec["type"]})
        if spec.get("nullable") is False:
            out.append({"type": "not_null", "field": name})
        if spec.get("unique"):
            out.append({"type": "unique", "field": name})
        if spec.get("min") is not None or spec.get("max") is not None:
            out.append({"type": "range", "field": name, "min": spec.get("min"), "max": spec.get("max")})
        if spec.get("pattern"):
            out.append({"type": "regex", "field": name, "pattern": spec["pattern"]})
        if spec.get("values"):
            out.append({"type": "in_set", "field": name, "values": spec["values"]})
        if spec.get("max_length"):
            out.append({"type": "length", "field": name, "max": spec["max_length"]})
    return out


def with_running_max(df: DataFrame, column: str, name: str, order_by=None, least=None) -> DataFrame:
    """``df`` with the greatest value of ``column`` before each row; ``least`` is that of earlier tables.

    Two passes: each range partition's own maximum, one row a partition, and a running
    maximum inside partitions that starts from those before.
    """
    from tidemill.plans.staging import staged

    order = [col(c) for c in names_of(order_by)] or [col(ORDINAL)]
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    tops = sorted((r["__p"], r["m"]) for r in held.groupBy("__p").agg(F.max(col(column)).alias("m")).collect())
    kind = df.schema[column].dataType
    cases, best = [], None if least is None else df.sparkSession.range(1).select(F.lit(least).cast(kind)).first()[0]
    for p, top in tops:
        cases += [F.lit(p), F.lit(best).cast(kind)]
        best = top if best is None else best if top is None else max(best, top)
    start = F.try_element_at(F.create_map(*cases), col("__p")) if cases else F.lit(None).cast(kind)
    inside = F.max(col(column)).over(Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1))
    return held.withColumn(name, F.greatest(inside, start)).drop("__p", "__i")


class Memory:
    """What rules with ``across_runs`` know of earlier tables; this one knows nothing."""

    def flag(self, df: DataFrame, spec: dict, keys: list[str], name: str) -> DataFrame:
        """``df`` with ``name`` also true where an earlier table has the row's key."""
        return df

    def greatest(self, spec: dict):
        """The greatest value of a sequence's field in earlier tables."""
        return None


def checked(df: DataFrame, rules: list[dict], schema: dict | None = None, memory: Memory | None = None) -> DataFrame:
    """``df`` with ``_violations``: an array of (rule, field, severity, message).

    ``unique`` and ``sequence`` rules that say ``across_runs`` also go by what ``memory`` knows.
    """
    memory = memory or Memory()
    specs = [*(expand_schema(schema) if schema else []), *rules]
    columns = df.columns
    ordered = any(RULES.key(s["type"]) in ("unique", "distinct", "sequence", "monotonic") and not s.get("order_by") for s in specs)
    if ordered and ORDINAL not in df.columns:
        df = df.withColumn(ORDINAL, F.monotonically_increasing_id())
    for s in specs:
        if RULES.key(s["type"]) in ("sequence", "monotonic"):
            df = with_running_max(df, s["field"], f"__before_{s['field']}", s.get("order_by"), memory.greatest(s) if s.get("across_runs") else None)
        if RULES.key(s["type"]) in ("unique", "distinct"):
            keys = names_of(s.get("columns")) or [s["field"]]
            df = with_repeats(df, keys, s.get("order_by"), _repeat_name(s))
            df = memory.flag(df, s, keys, _repeat_name(s)) if s.get("across_runs") else df
    found = []
    for s in specs:
        for message in RULES.get(s["type"])(Check(df, s)):
            text = F.when(message.isNotNull(), F.lit(s["message"])) if s.get("message") else message
            found.append(F.when(text.isNotNull(), F.struct(F.lit(s["type"]).alias("rule"), F.lit(s.get("field") or "").alias("field"), F.lit(s.get("severity", "error")).alias("severity"), text.alias("message"))))
    kind = "array<struct<rule:string,field:string,severity:string,message:string>>"
    all_ = F.array_compact(F.array(*found)) if found else F.array().cast(kind)
    return df.select(*(col(c) for c in columns), all_.cast(kind).alias("_violations"))


@dataclass
class Report:
    """Counts of a validated table."""

    checked: int = 0
    rejected: int = 0
    by_rule: dict = field(default_factory=dict)
    by_field: dict = field(default_factory=dict)
    by_severity: dict = field(default_factory=dict)
    samples: list = field(default_factory=list)


def report(df: DataFrame) -> Report:
    """Counts and some samples over a table with ``_violations``."""
    blocked = F.exists("_violations", lambda v: v["severity"] == "error")
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("bad")).first()
    out = Report(totals["n"], totals["bad"])
    flat = df.select(F.explode("_violations").alias("v")).select("v.*")
    for r in flat.groupBy("rule", "field", "severity").count().collect():
        for target, key in ((out.by_rule, r["rule"]), (out.by_field, r["field"]), (out.by_severity, r["severity"])):
            target[key] = target.get(key, 0) + r["count"]
    out.samples = [r.asDict() for r in flat.limit(MOST_SAMPLES).collect()]
    return out


def split(df: DataFrame, policy: str = "fail", max_errors: int | None = None, max_error_rate: float | None = None) -> tuple[DataFrame, DataFrame, Report]:
    """(accepted, rejected, report) of a table with ``_violations`` under a policy.

    ``fail`` raises on any rejected row; ``quarantine`` and ``drop`` part the rows; ``warn`` keeps
    them all and never trips the limits.  Only violations of severity error count.
    """
    if policy not in ("fail", "quarantine", "drop", "warn"):
        raise ConfigurationError("policy is fail, quarantine, drop or warn")
    counted = report(df)
    blocked = F.exists("_violations", lambda v: v["severity"] == "error")
    plain = df.drop("_violations")
    if policy == "warn":
        return plain, plain.where("false"), counted
    if policy == "fail" and counted.rejected:
        raise ValidationError(f"{counted.rejected} of {counted.checked} rows break rules: {counted.samples[:3]}")
    if max_errors is not None and counted.rejected > max_errors:
        raise ValidationError(f"{counted.rejected} rows break rules; at most {max_errors} may")
    rate = counted.rejected / counted.checked if counted.checked else 0.0
    if max_error_rate is not None and counted.checked >= RATE_NEEDS and rate > max_error_rate and not math.isclose(rate, max_error_rate):
        raise ValidationError(f"{rate:.2%} of rows break rules; at most {max_error_rate:.2%} may")
    messages = F.transform(F.filter("_violations", lambda v: v["severity"] == "error"), lambda v: F.concat(F.lit("["), v["rule"], F.lit("] "), v["message"]))
    bad = df.where(blocked).select(*(col(c) for c in plain.columns), F.array_join(messages, "; ").alias("_violations"))
    return df.where(~blocked).drop("_violations"), bad, counted
