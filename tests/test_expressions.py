import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.errors import ExpressionError
from tidemill.functions.expressions import compile_expression, failing
from tidemill.operators import apply_step

CASES = [
    ("1 + 2 * 3", 7), ("-7 // 2", -4), ("-7 % 3", 2), ("7 % -3", -2), ("2 ** 10", 1024), ("7 / 2", 3.5), ("1 / 0", None), ("coalesce(1 / 0, 5)", None),
    ("'a' + 'b'", "ab"), ("1 < 2 < 3", True), ("3 > 2 > 2", False), ("None == None", True), ("None != 1", True), ("1 == 1.0", True), ("1 == '1'", False),
    ("0 or 'x'", "x"), ("5 and 6", 6), ("not ''", True), ("'b' in 'abc'", True), ("2 in [1, 2]", True), ("None in [1]", False), ("'k' in {'k': 1}", True),
    ("1 if [] else 2", 2), ("[1, 2, 3][-1]", 3), ("[1, 2][5]", None), ("'hello'[1:3]", "el"), ("{'a': {'b': 4}}.a.b", 4), ("is_null('  ')", True), ("n is None", True),
    ("abs(-3)", 3), ("min(3, 1, 2)", 1), ("max([4, 9, 2])", 9), ("sum([1, 2, 3])", 6), ("round(2.5)", 2.0), ("round('3.14159', 2)", 3.14), ("floor(-1.5)", -2), ("ceil(1.2)", 2), ("sqrt(9)", 3.0), ("pow(2, 3)", 8.0),
    ("int('1,234')", 1234), ("int('x', 7)", 7), ("float('2.5')", 2.5), ("str(True)", "True"), ("str(None)", ""), ("str(1.0)", "1.0"), ("bool('false')", True), ("len('abc')", 3), ("len([1, 2])", 2),
    ("lower('AB')", "ab"), ("strip('  x ')", "x"), ("strip('xxaxx', 'x')", "a"), ("replace('a.b', '.', '-')", "a-b"), ("startswith('abc', 'ab')", True), ("endswith('abc', 'bc')", True), ("contains('abc', 'd')", False),
    ("split('a b  c')", ["a", "b", "c"]), ("split('a,b', ',')", ["a", "b"]), ("join('-', ['a', 'b'])", "a-b"), ("concat('a', 1, None)", "a1"), ("regex_match('^a+$', 'aaa')", True), ("slice('hello', -3)", "llo"),
    ("coalesce(None, 2)", 2), ("default(None, 'd')", "d"), ("year('2026-03-04')", 2026), ("month('04/03/2026')", 3), ("day(date_parse('2026-03-04', '%Y-%m-%d'))", 4), ("date_format('2026-03-04', '%d.%m.%y')", "04.03.26"),
    ("days_between('2026-03-04', '2026-03-01')", 3), ("keys({'a': 1})", ["a"]), ("values({'a': 1})", [1]), ("get({'a': 1}, 'z', 9)", 9), ("any([0, 1])", True), ("all([])", True), ("sorted([3, 1, 2], True)", [3, 2, 1]),
    ("params.limit + 1", 11), ("a * 2", 6), ("PI > 3", True),
]


def test_cases(spark):
    df = spark.createDataFrame([(3, None)], "a long, n string")
    compiled = [compile_expression(e, df.schema, {"params": {"limit": 10}, "state": {}}) for e, _ in CASES]
    row = df.select(*(v.col.alias(f"c{i}") for i, v in enumerate(compiled)), *(failing(v).alias(f"f{i}") for i, v in enumerate(compiled))).first()
    wrong = [(e, row[f"c{i}"], want) for i, (e, want) in enumerate(CASES) if row[f"c{i}"] != want or row[f"f{i}"]]
    assert not wrong


@pytest.mark.parametrize("source", ["x.__class__", "lambda: 1", "[i for i in [1]]", "open('x')", "_a", "f'{1}'", "abs(x=1)", "(y := 1)", "1 +", "a" * 2001, "abs(*[1])", "abs.real()"])
def test_what_isnt_allowed(spark, source):
    with pytest.raises(Exception) as e:
        compile_expression(source, spark.createDataFrame([(1,)], "x long").schema)
    assert isinstance(e.value, (ExpressionError, Exception)) and "tidemill" in type(e.value).__module__


def test_failures_follow_the_policy(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    got = lambda **o: [r["w"] for r in apply_step(df, {"type": "derive", "column": "w", "expression": "v + 1"} | o).orderBy("id").collect()]
    assert got() == [3.0, None]
    with pytest.raises(Exception, match="failed"):
        got(on_error="fail")
    assert apply_step(df, {"type": "filter", "expression": "v > 1", "on_error": "drop"}).count() == 1
    with pytest.raises(Exception, match="failed"):
        apply_step(df, {"type": "filter", "expression": "v > 1"}).collect()
    assert [r["w"] for r in apply_step(df, {"type": "derive", "column": "w", "expression": "nothing > 1"}).collect()] == [None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50).filter(bool)), min_size=1, max_size=20))
def test_integer_division_is_pythons(pairs):
    from pyspark.sql import SparkSession

    df = SparkSession.builder.getOrCreate().createDataFrame(pairs, "a long, b long")
    q, r = (compile_expression(e, df.schema).col for e in ("a // b", "a % b"))
    assert [tuple(x) for x in df.select(q, r).collect()] == [(a // b, a % b) for a, b in pairs]


def test_dates_compare_with_text(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 1, 2),)], "d timestamp_ntz")
    assert apply_step(df, {"type": "filter", "expression": "d > '2026-01-01'", "on_error": "drop"}).count() == 1
