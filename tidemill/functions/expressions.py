"""A small, safe expression language over columns.

Expressions have Python's syntax and compile to Catalyst columns; only listed syntax nodes
and functions are allowed.  Each part compiles to a value and, beside it, the conditions under
which evaluation fails: a type or null error, left to the caller's policy, or a division by
zero, which makes the whole expression null.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ExpressionError
from tidemill.functions.columns import as_text, blank, col, date_pattern, iso_text, number, parse_moment, strip
from tidemill.registry import Registry

MOST_CHARACTERS = 2000
MOST_NODES = 400
CONSTANTS = {"PI": 3.141592653589793, "E": 2.718281828459045, "true": True, "false": False, "null": None, "none": None}

FUNCTIONS = Registry("function")


@dataclass
class Value:
    """A compiled part: column, type, failures; ``const`` holds the literal if it is one."""

    col: Column
    kind: T.DataType
    failed: Column | None = None
    zero: Column | None = None
    const: object = ...

    def null(self) -> Column:
        return self.col.isNull()


def either(*flags: Column | None) -> Column | None:
    """The disjunction of those flags that there are."""
    out = None
    for f in flags:
        if f is not None:
            out = f if out is None else out | f
    return out


def _literal(v) -> Value:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), type(None): T.NullType()}
    if type(v) in kinds:
        if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
            raise ExpressionError("integers must fit 64 bits")
        return Value(F.lit(v).cast(kinds[type(v)]) if v is not None else F.lit(None), kinds[type(v)], const=v)
    if isinstance(v, (list, tuple)):
        items = [_literal(x) for x in v]
        return _array(items)
    if isinstance(v, dict):
        pairs = [(_literal(k), _literal(x)) for k, x in v.items()]
        return _map(pairs)
    raise ExpressionError(f"values of type {type(v).__name__} can't be used")


def _is_number(v: Value) -> bool:
    return isinstance(v.kind, (T.NumericType, T.BooleanType))


def _is_text(v: Value) -> bool:
    return isinstance(v.kind, T.StringType)


def _is_null(v: Value) -> bool:
    return isinstance(v.kind, T.NullType)


def _whole(v: Value) -> bool:
    return isinstance(v.kind, (T.IntegralType, T.BooleanType))


def _num(v: Value) -> Column:
    return v.col.cast("long") if isinstance(v.kind, T.BooleanType) else v.col


def text_of(v: Value) -> Column:
    """Python's str(), with null as the empty text."""
    return F.lit("") if _is_null(v) else F.coalesce(as_text(v.col, v.kind), F.lit(""))


def truthy(v: Value) -> Column:
    """Python's bool()."""
    if isinstance(v.kind, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if isinstance(v.kind, T.NumericType):
        return F.coalesce(v.col != 0, F.lit(False))
    if _is_text(v):
        return F.coalesce(F.length(v.col) > 0, F.lit(False))
    if isinstance(v.kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return F.lit(False) if _is_null(v) else v.col.isNotNull()


def _common(values: list[Value]) -> T.DataType:
    kinds = {v.kind.simpleString(): v.kind for v in values if not _is_null(v)}
    if not kinds:
        return T.NullType()
    if len(kinds) == 1:
        return next(iter(kinds.values()))
    if all(isinstance(k, T.IntegralType) for k in kinds.values()):
        return T.LongType()
    if all(isinstance(k, (T.NumericType, T.BooleanType)) for k in kinds.values()):
        return T.DoubleType()
    return T.StringType()


def _cast(v: Value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType) and not _is_text(v):
        return F.lit(None).cast("string") if _is_null(v) else as_text(v.col, v.kind)
    return v.col.cast(kind) if not isinstance(kind, T.NullType) else v.col


def _array(items: list[Value]) -> Value:
    kind = _common(items)
    const = [i.const for i in items] if all(i.const is not ... for i in items) else ...
    made = F.array(*(_cast(i, kind) for i in items)) if items else F.array().cast("array<string>")
    return Value(made, T.ArrayType(kind if items else T.StringType()), either(*(i.failed for i in items)), either(*(i.zero for i in items)), const)


def _map(pairs: list[tuple[Value, Value]]) -> Value:
    kind = _common([v for _, v in pairs])
    made = F.create_map(*(x for k, v in pairs for x in (text_of(k), _cast(v, kind)))) if pairs else F.create_map().cast("map<string,string>")
    flat = [x for p in pairs for x in p]
    const = {k.const: v.const for k, v in pairs} if all(x.const is not ... for x in flat) else ...
    return Value(made, T.MapType(T.StringType(), kind), either(*(x.failed for x in flat)), either(*(x.zero for x in flat)), const)


def choose(condition: Column, a: Value, b: Value) -> Value:
    """``a`` where the condition holds, else ``b``; only the branch taken can fail."""
    kind = _common([a, b])
    pick = lambda x, y: None if x is None and y is None else F.when(condition, F.lit(False) if x is None else x).otherwise(F.lit(False) if y is None else y)
    return Value(F.when(condition, _cast(a, kind)).otherwise(_cast(b, kind)), kind, pick(a.failed, b.failed), pick(a.zero, b.zero))


class Compiler(ast.NodeVisitor):
    """Compiles one expression for the columns of a DataFrame."""

    def __init__(self, schema: T.StructType, scope: dict | None = None):
        self.fields = {f.name: f.dataType for f in schema.fields}
        self.scope = scope or {}

    def generic_visit(self, node):
        raise ExpressionError(f"{type(node).__name__} isn't allowed in expressions")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        if isinstance(node.value, (bytes, complex)) or node.value is ...:
            raise ExpressionError("that kind of constant isn't allowed")
        return _literal(node.value)

    def visit_Name(self, node):
        name = node.id
        if name.startswith("_"):
            raise ExpressionError("names may not start with an underscore")
        if name in self.scope:
            return _literal(self.scope[name])
        if name == "row":
            return Value(F.struct(*(col(c) for c in self.fields)), T.StructType([T.StructField(n, k) for n, k in self.fields.items()]))
        if name in self.fields:
            return Value(col(name), self.fields[name])
        if name in CONSTANTS:
            return _literal(CONSTANTS[name])
        return Value(F.lit(None), T.NullType(), F.lit(True))  # an unknown name fails where it is reached

    def visit_List(self, node):
        return _array([self.visit(e) for e in node.elts])

    visit_Tuple = visit_List

    def visit_Set(self, node):
        made = self.visit_List(node)
        return Value(F.array_distinct(made.col), made.kind, made.failed, made.zero, made.const)

    def visit_Dict(self, node):
        return _map([(self.visit(k), self.visit(v)) for k, v in zip(node.keys, node.values)])

    def visit_IfExp(self, node):
        test = self.visit(node.test)
        out = choose(truthy(test), self.visit(node.body), self.visit(node.orelse))
        return Value(out.col, out.kind, either(test.failed, out.failed), either(test.zero, out.zero))

    def visit_BoolOp(self, node):
        values = [self.visit(v) for v in node.values]
        out = values[-1]
        for v in reversed(values[:-1]):
            rest = choose(truthy(v), out, v) if isinstance(node.op, ast.And) else choose(truthy(v), v, out)
            out = Value(rest.col, rest.kind, either(v.failed, rest.failed), either(v.zero, rest.zero))
        return out

    def visit_UnaryOp(self, node):
        v = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~truthy(v), T.BooleanType(), v.failed, v.zero)
        if not isinstance(node.op, (ast.USub, ast.UAdd)):
            return self.generic_visit(node)
        if not _is_number(v):
            return Value(F.lit(None), T.NullType(), F.lit(True))
        if v.const is not ...:
            return _literal(-v.const if isinstance(node.op, ast.USub) else +v.const)
        made = -_num(v) if isinstance(node.op, ast.USub) else _num(v)
        return Value(made, T.LongType() if isinstance(v.kind, T.BooleanType) else v.kind, either(v.failed, v.null()), v.zero)

    def visit_BinOp(self, node):
        a, b = self.visit(node.left), self.visit(node.right)
        failed, zero = either(a.failed, b.failed), either(a.zero, b.zero)
        op = type(node.op)
        if op is ast.Add and _is_text(a) and _is_text(b):
            return Value(F.concat(a.col, b.col), T.StringType(), either(failed, a.null(), b.null()), zero)
        if op is ast.Add and isinstance(a.kind, T.ArrayType) and isinstance(b.kind, T.ArrayType):
            return Value(F.concat(a.col, b.col), a.kind, either(failed, a.null(), b.null()), zero)
        if op not in (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow):
            return self.generic_visit(node.op)
        if not (_is_number(a) and _is_number(b)):
            return Value(F.lit(None), T.NullType(), F.lit(True))
        failed = either(failed, a.null(), b.null())
        x, y = _num(a), _num(b)
        exact = isinstance(a.kind, T.DecimalType) or isinstance(b.kind, T.DecimalType)
        kind = T.LongType() if _whole(a) and _whole(b) else T.DecimalType(38, 18) if exact else T.DoubleType()
        if op in (ast.Div, ast.FloorDiv, ast.Mod):
            zero = either(zero, F.coalesce(y == 0, F.lit(False)))
            ratio = F.try_divide(x.cast("double"), y.cast("double"))
            if op is ast.Div:
                return Value(ratio, T.DoubleType(), failed, zero)
            if kind == T.LongType():
                down = F.when(y != 0, F.try_divide(x - F.pmod(F.when(y < 0, -x).otherwise(x), F.abs(y)) * F.when(y < 0, -1).otherwise(1), y).cast("long"))
                rest = F.when(y != 0, x - down * y)
                return Value(down if op is ast.FloorDiv else rest, kind, failed, zero)
            down = F.floor(ratio).cast("double")
            return Value(down if op is ast.FloorDiv else x.cast("double") - down * y.cast("double"), T.DoubleType(), failed, zero)
        if op is ast.Pow:
            if kind == T.LongType() and isinstance(b.const, int) and b.const >= 0:
                return Value(F.power(x, y).try_cast("long"), kind, failed, zero)
            return Value(F.power(x.cast("double"), y.cast("double")), T.DoubleType(), failed, zero)
        made = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[op](x.cast(kind), y.cast(kind))
        return Value(made, kind, failed, zero)

    def visit_Compare(self, node):
        left, out = self.visit(node.left), None
        for op, right in zip(node.ops, node.comparators):
            right = self.visit(right)
            step = self._compare(type(op), left, right)
            if out is None:
                out = step
            else:
                both = choose(out.col, step, out)
                out = Value(both.col, T.BooleanType(), either(out.failed, both.failed), either(out.zero, both.zero))
            left = right
        return out

    def _compare(self, op, a: Value, b: Value) -> Value:
        failed, zero = either(a.failed, b.failed), either(a.zero, b.zero)
        made = lambda c, bad=None: Value(c, T.BooleanType(), either(failed, bad), zero)
        if op in (ast.In, ast.NotIn):
            return made(self._inside(a, b) if op is ast.In else ~self._inside(a, b))
        alike = (_is_number(a) and _is_number(b)) or type(a.kind) is type(b.kind)
        dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
        if isinstance(a.kind, dates) and (isinstance(b.kind, dates) or _is_text(b)) or _is_text(a) and isinstance(b.kind, dates):
            a, b = (Value(parse_moment(v.col, v.kind), T.TimestampNTZType()) for v in (a, b))
            alike = True
        if op in (ast.Eq, ast.NotEq, ast.Is, ast.IsNot):
            if _is_null(a) or _is_null(b):
                same = a.null() & b.null()
            elif not alike:
                same = a.null() & b.null()
            else:
                same = _num(a).eqNullSafe(_num(b))
            return made(same if op in (ast.Eq, ast.Is) else ~same)
        if not alike or _is_null(a):
            return Value(F.lit(None).cast("boolean"), T.BooleanType(), F.lit(True), zero)
        x, y = _num(a), _num(b)
        result = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[op]
        return made(result, a.null() | b.null())

    def _inside(self, a: Value, b: Value) -> Column:
        if isinstance(b.kind, T.ArrayType):
            if _is_null(a) or not (_is_number(a) and isinstance(b.kind.elementType, (T.NumericType, T.BooleanType)) or type(a.kind) is type(b.kind.elementType)):
                return F.lit(False)
            return F.coalesce(F.array_contains(b.col, a.col), F.lit(False))
        if isinstance(b.kind, T.MapType):
            return F.coalesce(F.array_contains(F.map_keys(b.col), text_of(a)), F.lit(False))
        if _is_text(a) and _is_text(b):
            return F.coalesce(b.col.contains(a.col), F.lit(False))
        return F.lit(False)

    def visit_Attribute(self, node):
        if node.attr.startswith("_"):
            raise ExpressionError("attributes may not start with an underscore")
        return self._item(self.visit(node.value), _literal(node.attr))

    def visit_Subscript(self, node):
        v = self.visit(node.value)
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None:
                raise ExpressionError("slices have no step here")
            ends = [None if e is None else self.visit(e).const for e in (node.slice.lower, node.slice.upper)]
            if any(e is ... or isinstance(e, (str, float)) for e in ends):
                raise ExpressionError("slice ends must be whole constants")
            return Value(_sliced(v, *ends), v.kind, v.failed, v.zero)
        return self._item(v, self.visit(node.slice))

    def _item(self, v: Value, key: Value) -> Value:
        failed, zero = either(v.failed, key.failed), either(v.zero, key.zero)
        if isinstance(v.const, dict):
            return _literal(v.const.get(key.const)) if key.const is not ... else Value(F.try_element_at(v.col, text_of(key)), v.kind.valueType, failed, zero)
        if isinstance(v.kind, T.StructType):
            if key.const in v.kind.fieldNames():
                return Value(v.col.getField(key.const), v.kind[key.const].dataType, failed, zero)
            return Value(F.lit(None), T.NullType(), failed, zero)
        if isinstance(v.kind, T.MapType):
            return Value(F.try_element_at(v.col, text_of(key)), v.kind.valueType, failed, zero)
        if isinstance(v.kind, T.ArrayType) and _whole(key):
            at = key.col.cast("int")
            return Value(F.try_element_at(v.col, F.when(at >= 0, at + 1).otherwise(at)), v.kind.elementType, failed, zero)
        if _is_text(v) and _whole(key):
            at = key.col.cast("int")
            found = F.substring(v.col, F.when(at >= 0, at + 1).otherwise(at), F.lit(1))
            return Value(F.when((at < F.length(v.col)) & (at >= -F.length(v.col)), found), v.kind, failed, zero)
        return Value(F.lit(None), T.NullType(), failed, zero)

    def visit_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise ExpressionError("only plain calls of listed functions are allowed")
        build = FUNCTIONS.get(node.func.id)
        args = [self.visit(a) for a in node.args]
        try:
            out = build(*args)
        except TypeError as e:
            raise ExpressionError(f"{node.func.id}: {e}") from None
        return Value(out.col, out.kind, either(out.failed, *(a.failed for a in args)), either(out.zero, *(a.zero for a in args)), out.const)


def _sliced(v: Value, start, end) -> Column:
    size = F.length(v.col) if _is_text(v) else F.size(v.col)
    place = lambda e, default: default if e is None else F.least(F.lit(e), size) if e >= 0 else F.greatest(size + e, F.lit(0))
    a, b = place(start, F.lit(0)), place(end, size)
    count = F.greatest(b - a, F.lit(0))
    return F.substring(v.col, a + 1, count) if _is_text(v) else F.slice(v.col, a + 1, count)


def compile_expression(source: str, schema: T.StructType, scope: dict | None = None) -> Value:
    """Compile an expression for a schema; ``scope`` holds further names with plain values."""
    if not isinstance(source, str) or len(source) > MOST_CHARACTERS:
        raise ExpressionError(f"an expression is text of at most {MOST_CHARACTERS} characters")
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"{source!r}: {e.msg}") from None
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise ExpressionError(f"an expression has at most {MOST_NODES} parts")
    v = Compiler(schema, scope).visit(tree)
    if v.zero is not None:
        zero = F.coalesce(v.zero, F.lit(False))
        v = Value(F.when(~zero, v.col), v.kind, None if v.failed is None else v.failed & ~zero)
    return v


def failing(v: Value) -> Column:
    """True on rows where evaluation fails."""
    return F.lit(False) if v.failed is None else F.coalesce(v.failed, F.lit(False))


def evaluate(source: str, names: dict):
    """The value of an expression over plain values, for conditions outside any table."""
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    v = compile_expression(source, T.StructType([]), names)
    row = spark.range(1).select(v.col.alias("v"), failing(v).alias("failed"), truthy(v).alias("true")).first()
    if row["failed"]:
        raise ExpressionError(f"{source!r} failed")
    return row["v"], row["true"]


# ---- functions --------------------------------------------------------------------------------


def _function(*names: str) -> Callable:
    return FUNCTIONS.register(*names)


def _text(column: Column, failed: Column | None = None) -> Value:
    return Value(column, T.StringType(), failed)


def _flag(column: Column, failed: Column | None = None) -> Value:
    return Value(column, T.BooleanType(), failed)


def _numeric(v: Value, use: Callable[[Column], Column], kind: T.DataType | None = None, bad: Callable[[Column], Column] | None = None) -> Value:
    if not _is_number(v):
        return Value(F.lit(None), T.NullType(), F.lit(True))
    x = _num(v)
    return Value(use(x), kind or (T.LongType() if isinstance(v.kind, T.BooleanType) else v.kind), either(v.null(), bad(x) if bad else None))


@_function("abs")
def _abs(v):
    return _numeric(v, F.abs)


def _extreme(args, several, one):
    if len(args) == 1 and isinstance(args[0].kind, T.ArrayType):
        a = args[0]
        return Value(one(a.col), a.kind.elementType, a.null() | (F.size(a.col) == 0) | F.exists(a.col, lambda x: x.isNull()))
    if len(args) < 2:
        return Value(F.lit(None), T.NullType(), F.lit(True))
    kind = _common(list(args))
    mixed = len({_is_text(a) for a in args if not _is_null(a)}) > 1
    return Value(several(*(_cast(a, kind) for a in args)), kind, either(F.lit(True) if mixed else None, *(a.null() for a in args)))


@_function("min")
def _min(*args):
    return _extreme(args, F.least, F.array_min)


@_function("max")
def _max(*args):
    return _extreme(args, F.greatest, F.array_max)


@_function("sum")
def _sum(a):
    if not isinstance(a.kind, T.ArrayType) or not isinstance(a.kind.elementType, T.NumericType):
        return Value(F.lit(None), T.NullType(), F.lit(True))
    kind = T.LongType() if isinstance(a.kind.elementType, T.IntegralType) else T.DoubleType()
    total = F.aggregate(a.col, F.lit(0).cast(kind), lambda s, x: s + x.cast(kind))
    return Value(total, kind, a.null() | F.exists(a.col, lambda x: x.isNull()))


@_function("round")
def _round(v, digits=None):
    n = 0 if digits is None else digits.const
    if not isinstance(n, int):
        raise ExpressionError("round takes a whole constant for digits")
    x = number(v.col, v.kind) if not _is_null(v) else F.lit(None).cast("double")
    return Value(F.bround(x, min(abs(n), 12)), T.DoubleType())


@_function("floor")
def _floor(v):
    return _numeric(v, lambda x: F.floor(x).cast("long"), T.LongType())


@_function("ceil")
def _ceil(v):
    return _numeric(v, lambda x: F.ceil(x).cast("long"), T.LongType())


@_function("sqrt")
def _sqrt(v):
    return _numeric(v, lambda x: F.when(x >= 0, F.sqrt(x.cast("double"))), T.DoubleType(), lambda x: x < 0)


@_function("pow")
def _pow(a, b):
    if not (_is_number(a) and _is_number(b)):
        return Value(F.lit(None), T.NullType(), F.lit(True))
    return Value(F.power(_num(a).cast("double"), _num(b).cast("double")), T.DoubleType(), a.null() | b.null())


def _or_default(found: Column, kind: T.DataType, default: Value | None) -> Value:
    return Value(found if default is None or _is_null(default) else F.coalesce(found, default.col.cast(kind)), kind)


@_function("int")
def _int(v, default=None):
    x = v.col.cast("double") if _is_number(v) else number(v.col, v.kind) if not _is_null(v) else F.lit(None).cast("double")
    whole = v.col.cast("long") if _whole(v) else F.when(F.abs(x) < 9.2e18, x).cast("long")
    return _or_default(whole, T.LongType(), default)


@_function("float")
def _float(v, default=None):
    x = v.col.cast("double") if isinstance(v.kind, T.NumericType) else _num(v).cast("double") if _is_number(v) else number(v.col, v.kind) if not _is_null(v) else F.lit(None).cast("double")
    return _or_default(x, T.DoubleType(), default)


@_function("str")
def _str(v):
    return _text(text_of(v))


@_function("bool")
def _bool(v):
    return _flag(truthy(v))


@_function("decimal")
def _decimal(v):
    kind = T.DecimalType(38, 18)
    x = F.lit(None).cast(kind) if _is_null(v) else as_text(v.col, v.kind).try_cast(kind)
    return Value(x, kind, either(x.isNull()))


@_function("len")
def _len(v):
    if _is_text(v):
        return Value(F.length(v.col).cast("long"), T.LongType(), v.null())
    if isinstance(v.kind, (T.ArrayType, T.MapType)):
        return Value(F.size(v.col).cast("long"), T.LongType(), v.null())
    return Value(F.lit(None), T.NullType(), F.lit(True))


@_function("lower")
def _lower(v):
    return _text(F.lower(text_of(v)))


@_function("upper")
def _upper(v):
    return _text(F.upper(text_of(v)))


@_function("strip")
def _strip(v, chars=None):
    return _text(strip(text_of(v)) if chars is None or _is_null(chars) else F.btrim(text_of(v), chars.col))


@_function("replace")
def _replace(v, old, new):
    return _text(F.replace(text_of(v), text_of(old), text_of(new)))


@_function("startswith")
def _startswith(v, part):
    return _flag(F.startswith(text_of(v), text_of(part)))


@_function("endswith")
def _endswith(v, part):
    return _flag(F.endswith(text_of(v), text_of(part)))


@_function("contains")
def _contains(v, part):
    return _flag(F.contains(text_of(v), text_of(part)))


@_function("split")
def _split(v, sep=None):
    if sep is None or _is_null(sep):
        stripped = strip(text_of(v))
        parts = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"(?U)\s+", -1))
        return Value(parts, T.ArrayType(T.StringType()))
    if not isinstance(sep.const, str) or not sep.const:
        raise ExpressionError("split takes a constant separator")
    return Value(F.split(text_of(v), "\\Q" + sep.const.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), T.ArrayType(T.StringType()))


@_function("join")
def _join(sep, items):
    if not isinstance(items.kind, T.ArrayType):
        return Value(F.lit(None), T.NullType(), F.lit(True))
    texts = F.transform(items.col, lambda x: F.coalesce(as_text(x, items.kind.elementType), F.lit("None")))
    return _text(F.array_join(texts, sep.const if isinstance(sep.const, str) else ""), items.null())


@_function("concat")
def _concat(*args):
    return _text(F.concat(F.lit(""), *(text_of(a) for a in args)))


@_function("regex_match")
def _regex_match(pattern, v):
    if not isinstance(pattern.const, str) or len(pattern.const) > 200:
        raise ExpressionError("regex_match takes a constant pattern of at most 200 characters")
    return _flag(F.lit(False) if _is_null(v) else F.coalesce(as_text(v.col, v.kind).rlike(pattern.const.replace("(?P<", "(?<")), F.lit(False)))


@_function("slice")
def _slice(v, start=None, end=None):
    ends = [None if e is None else e.const for e in (start, end)]
    if any(e is ... for e in ends):
        raise ExpressionError("slice ends must be constants")
    held = v if isinstance(v.kind, T.ArrayType) else _text(text_of(v))
    return Value(_sliced(held, *ends), held.kind)


@_function("coalesce")
def _coalesce(*args):
    kind = _common(list(args))
    return Value(F.coalesce(*(_cast(a, kind) for a in args)), kind)


@_function("is_null")
def _null(v):
    return _flag(F.lit(True) if _is_null(v) else blank(v.col) if _is_text(v) else v.null())


@_function("is_not_null")
def _not_null(v):
    return _flag(~_null(v).col)


@_function("default")
def _default(v, other):
    return _coalesce(v, other)


@_function("date_parse")
def _date_parse(v, pattern=None):
    if _is_null(v):
        return Value(F.lit(None).cast("timestamp_ntz"), T.TimestampNTZType())
    return Value(parse_moment(v.col, v.kind, None if pattern is None else pattern.const), T.TimestampNTZType())


@_function("date_format")
def _date_format(v, pattern=None):
    moment = _date_parse(v)
    return _text(iso_text(moment.col) if pattern is None else F.date_format(moment.col, date_pattern(pattern.const)))


def _part(name: str, use: Callable[[Column], Column]) -> None:
    @_function(name)
    def build(v):
        return Value(use(_date_parse(v).col).cast("long"), T.LongType())


_part("year", F.year)
_part("month", F.month)
_part("day", F.dayofmonth)


@_function("days_between")
def _days_between(a, b):
    micros = lambda v: F.unix_micros(_date_parse(v).col.cast("timestamp"))
    return Value(F.floor((micros(a) - micros(b)) / F.lit(86_400_000_000)).cast("long"), T.LongType())


@_function("keys")
def _keys(m):
    kind = T.ArrayType(T.StringType())
    if isinstance(m.kind, T.StructType):
        return Value(F.array(*(F.lit(n) for n in m.kind.fieldNames())), kind)
    empty = F.array().cast("array<string>")
    return Value(F.coalesce(F.map_keys(m.col), empty) if isinstance(m.kind, T.MapType) else empty, kind)


@_function("values")
def _values(m):
    if isinstance(m.kind, T.MapType):
        kind = T.ArrayType(m.kind.valueType)
        return Value(F.coalesce(F.map_values(m.col), F.array().cast(kind)), kind)
    if isinstance(m.kind, T.StructType):
        return _array([Value(m.col.getField(f.name), f.dataType) for f in m.kind.fields])
    return Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()))


@_function("get")
def _get(m, key, default=None):
    found = Compiler(T.StructType([]))._item(m, key)
    return found if default is None else _coalesce(found, default)


@_function("any")
def _any(a):
    return _every(a, F.exists)


@_function("all")
def _all(a):
    return _every(a, F.forall)


def _every(a, use):
    if not isinstance(a.kind, T.ArrayType):
        return Value(F.lit(None), T.NullType(), F.lit(True))
    return _flag(use(a.col, lambda x: truthy(Value(x, a.kind.elementType))), a.null())


@_function("sorted")
def _sorted(a, reverse=None):
    if not isinstance(a.kind, T.ArrayType):
        return Value(F.lit(None), T.NullType(), F.lit(True))
    down = reverse is not None and bool(reverse.const)
    return Value(F.sort_array(a.col, not down), a.kind, a.null())


def derive(df: DataFrame, source: str, scope: dict | None = None) -> tuple[Column, Column]:
    """(value, failed) of an expression over the columns of ``df``."""
    v = compile_expression(source, df.schema, scope)
    return v.col, failing(v)
