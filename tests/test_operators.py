"""Steps and rules on small literal tables."""

import hashlib
import hmac

import pytest
from pyspark.sql import Row

from tidemill.errors import ConfigurationError, ValidationError
from tidemill.operators import STEPS, apply_step, apply_steps
from tidemill.operators import rules as quality
from tidemill.operators.base import StepContext
from tidemill.operators.privacy import decrypt
from tidemill.operators.shape import tidy_name
from tidemill.plans import extraction


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Alice", "alice@corp.com", 100.5, "EU"), (2, "Bob", "bob@corp.com", -5.0, "EU"), (3, "Carol", "carol@corp.com", 250.0, "US"), (4, "Dave", "not-an-email", 10.0, "US"), (5, "Eve", "eve@corp.com", None, "EU")]
    return spark.createDataFrame(rows, "id long, name string, email string, amount double, region string")


def values(df, name):
    return [r[name] for r in df.collect()]


def test_every_step_and_rule_is_there():
    assert {"rename", "drop", "select", "normalize_columns", "add_column", "derive", "cast", "fill_null", "map_values", "split_column", "concat_columns", "flatten", "string_ops", "add_metadata", "filter", "limit", "join", "aggregate", "sort", "deduplicate", "dedupe_batch", "parse_date", "convert_timezone", "convert_currency", "hash_columns", "encrypt_columns", "mask_pii"} <= set(STEPS.names())
    assert len(quality.RULES.names()) == 27
    with pytest.raises(ConfigurationError):
        STEPS.get("none")


def test_names():
    assert [tidy_name(n) for n in ("Order Date", "OrderDate", "  Customer   E-Mail ", "Montréal", "!!!")] == ["order_date", "order_date", "customer_e_mail", "montreal", "column"]


def test_cast_table(spark):
    cases = [("42", "integer", 42), ("1,234", "integer", 1234), ("3.5", "float", 3.5), ("true", "boolean", True), ("NO", "boolean", False), ("2026-01-15T10:30:00", "date", "2026-01-15"), ("not a number", "integer", None), ("2026-01-15", "datetime", "2026-01-15T00:00:00")]
    for text, target, want in cases:
        df = spark.createDataFrame([(text,)], "v string")
        assert values(apply_step(df, {"type": "cast", "columns": {"v": target}}), "v") == [want]
    with pytest.raises(Exception, match="cast v"):
        apply_step(df.selectExpr("'x' as v"), {"type": "cast", "columns": {"v": "integer"}, "on_error": "fail"}).collect()
    assert values(apply_step(df.selectExpr("'x' as v"), {"type": "cast", "columns": {"v": "integer"}, "on_error": "keep"}), "v") == ["x"]


def test_clean_values(spark):
    df = spark.createDataFrame([(None, "  ", 1, "  a   b  ")], "a long, b string, c long, d string")
    out = apply_steps(df, [{"type": "fill_null", "columns": {"a": 0, "b": "unknown"}}, {"type": "map_values", "column": "c", "mapping": {"1": "EUR"}, "default": "OTHER"}, {"type": "string_ops", "columns": "d", "operations": "trim,collapse_spaces,upper"}]).first()
    assert tuple(out) == (0, "unknown", "EUR", "A B")


def test_flatten(spark):
    df = spark.createDataFrame([Row(a=Row(b=Row(c=1)), d=2, m={"k": 3}, x=[1, 2])])
    out = apply_step(df, {"type": "flatten", "keep_lists": False})
    assert out.columns == ["a.b.c", "d", "m.k", "x.0", "x.1"] and tuple(out.first()) == (1, 2, 3, 1, 2)
    assert apply_step(df, {"type": "flatten", "columns": "a", "max_depth": 1}).columns == ["a.b", "d", "m", "x"]


def test_dates_and_money(spark):
    df = spark.createDataFrame([("15/03/2026", "2026-01-01T12:00:00", "10.10", "USD")], "d string, t string, m string, c string")
    out = apply_steps(df, [{"type": "parse_date", "columns": "d"}, {"type": "convert_timezone", "columns": "t", "from": "+02:00"}, {"type": "convert_currency", "columns": "m", "rates": {"USD": 0.9}, "currency_column": "c"}]).first()
    assert tuple(out)[:3] == ("2026-03-15T00:00:00", "2026-01-01T10:00:00+00:00", "9.09")


def test_privacy(spark, people):
    assert values(apply_step(people, {"type": "mask_pii", "columns": "email"}), "email")[0] == "a****@corp.com"
    assert values(apply_step(people, {"type": "mask_pii", "columns": "name", "strategy": "full"}), "name")[:2] == ["*****", "***"]
    assert values(apply_step(people, {"type": "hash_columns", "columns": "name", "key": "k"}), "name")[0] == hmac.new(b"k", b"Alice", "sha256").hexdigest()
    assert values(apply_step(people, {"type": "hash_columns", "columns": "name", "algorithm": "blake2b"}), "name")[0] == hashlib.blake2b(b"Alice").hexdigest()
    sealed = apply_step(people, {"type": "encrypt_columns", "columns": "name", "key": "secret"})
    token = sealed.first()["name"]
    back = spark.createDataFrame([(token,)], "name string").select(decrypt("name", "secret", token.split(":")[1]).alias("name"))
    assert back.first()["name"] == "Alice" and token != "Alice"


def test_order_and_duplicates(spark):
    df = spark.createDataFrame([(3, "a"), (None, "b"), (1, "a")], "n long, g string")
    assert values(apply_step(df, {"type": "sort", "columns": "n"}), "n") == [1, 3, None]
    assert values(apply_step(df, {"type": "sort", "columns": "n desc"}), "n") == [None, 3, 1]
    assert values(apply_step(df, {"type": "sort", "columns": "n desc", "nulls_last": False}), "n") == [3, 1, None]
    pairs = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string").coalesce(1)
    assert values(apply_step(pairs, {"type": "deduplicate", "columns": "k"}), "v") == ["a"]
    assert values(apply_step(pairs, {"type": "deduplicate", "columns": "k", "keep": "last"}), "v") == ["b"]


def test_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", None)], "g string, v double").coalesce(1)
    spec = {"type": "aggregate", "group_by": "g", "aggregations": {"v": "sum", "mean": {"column": "v", "function": "mean"}, "n": {"column": "v", "function": "count"}, "high": {"column": "v", "function": "max"}, "last": {"column": "v", "function": "last"}, "all": {"column": "v", "function": "list"}}}
    assert sorted(map(tuple, apply_step(df, spec).collect())) == [("a", 4.0, 2.0, 2, 3.0, 3.0, [1.0, 3.0]), ("b", 10.0, 10.0, 1, 10.0, None, [10.0])]
    assert apply_step(df.where("false"), {"type": "aggregate", "aggregations": {"v": "sum"}}).collect() == []
    with pytest.raises(ConfigurationError):
        apply_step(df, {"type": "aggregate", "aggregations": {"v": "median"}})


def test_join(spark):
    left = spark.createDataFrame([("EU", 1), ("XX", 2), (None, 3)], "region string, n long")
    right = spark.createDataFrame([("EU", "Europe"), ("EU", "again"), (None, "none")], "code string, label string").coalesce(1)
    step = {"type": "join", "source": right, "left_on": "region", "right_on": "code"}
    assert sorted((r["n"], r["label"]) for r in apply_step(left, step).collect()) == [(1, "Europe"), (2, None), (3, "none")]
    assert apply_step(left, step | {"how": "inner"}).count() == 2
    with pytest.raises(ConfigurationError):
        apply_step(left, step | {"left_on": "n"})


def test_numbers_of_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = apply_step(df, {"type": "add_metadata", "include": "row_number,batch", "order_by": "k"}, StepContext(batch_size=100))
    assert all(r["_row_number"] == r["k"] + 1 and r["_batch"] == r["k"] // 100 for r in out.collect())


def test_rules_and_policies(spark, people):
    rules = [{"type": "email", "field": "email"}, {"type": "range", "field": "amount", "min": 0}, {"type": "not_null", "field": "amount", "severity": "warning"}]
    found = quality.checked(people, rules)
    good, bad, report = quality.split(found, "quarantine")
    assert sorted(values(good, "id")) == [1, 3, 5] and sorted(values(bad, "id")) == [2, 4]
    assert report.by_rule == {"email": 1, "range": 1, "not_null": 1} and (report.checked, report.rejected) == (5, 2)
    assert quality.split(found, "warn")[0].count() == 5
    for more in ({"policy": "fail"}, {"policy": "drop", "max_errors": 1}):
        with pytest.raises(ValidationError):
            quality.split(found, **more)
    many = quality.checked(spark.range(200).selectExpr("id", "case when id < 150 then -1 else 1 end as v"), [{"type": "range", "field": "v", "min": 0}])
    with pytest.raises(ValidationError):
        quality.split(many, "drop", max_error_rate=0.05)


def test_sequence_in_parallel(spark):
    df = spark.range(500).selectExpr("id", "case when id % 50 = 7 then id - 20 else id end as v")
    found = quality.checked(df, [{"type": "sequence", "field": "v", "order_by": "id"}])
    assert sorted(values(found.where("size(_violations) > 0"), "id")) == [i for i in range(500) if i % 50 == 7]


def test_drift_and_marks(spark):
    old, new = {"a": "bigint"}, {"a": "string", "b": "int"}
    found = extraction.drift(old, new)
    assert found == {"added": ["b"], "removed": [], "changed": ["a"]} and not any(extraction.drift(None, new).values())
    extraction.check_drift(found, "permissive")
    for policy in ("strict", "additive"):
        with pytest.raises(Exception, match="changed"):
            extraction.check_drift(found, policy)
    assert extraction.rewound("2026-01-02", 3600) == "2026-01-01T23:00:00" and extraction.rewound(5, 10) == 5
    assert extraction.later_mark("b", "a") == "b" and extraction.later_mark(None, 3) == 3
