import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError
from tidemill.operators import apply_step, shape
from tidemill.operators.aggregates import AGGREGATES, Aggregate, register
from tidemill.operators.whole import table_step
from tidemill.plans.rollup import Rollup
from tidemill.sources.base import read_source, write_sink


@pytest.fixture
def product():
    @register("product_for_test")
    def made() -> Aggregate:
        return Aggregate(lambda c, kind: F.product(c), F.product, lambda s: F.coalesce(s, F.lit(1.0)))

    yield
    del AGGREGATES._found["product_for_test"]


def test_states_of_runs_merge(spark, tmp_path, product):
    rows = [(i % 3 if i % 10 else None, float(i % 7), f"u{i % 500}") for i in range(3000)]
    specs = {"n": {"column": "v", "function": "count"}, "s": {"column": "v", "function": "sum"}, "m": {"column": "v", "function": "mean"}, "d": {"column": "v", "function": "stddev"}, "u": {"column": "u", "function": "approx_count_distinct"}, "q": {"column": "v", "function": "approx_p90"}, "p": {"column": "g", "function": "product_for_test"}}
    whole = spark.createDataFrame(rows, "g long, v double, u string")
    rollup = Rollup(spark, str(tmp_path / "r"), "g", specs)
    for part in (0, 1, 2, 0):
        write_sink(spark.createDataFrame(rows[part::3], "g long, v double, u string"), {"type": "rollup", "path": str(tmp_path / "r"), "group_by": "g", "aggregations": specs, "batch": part})
    once = {r["g"]: r for r in apply_step(whole, {"type": "aggregate", "group_by": "g", "aggregations": specs}).collect()}
    for _ in range(2):
        got = {r["g"]: r for r in rollup.result().collect()}
        assert got.keys() == once.keys() == {0, 1, 2, None}
        for g, r in got.items():
            values = [v for k, v, _ in rows if k == g]
            assert (r["n"], r["s"]) == (len(values), sum(values)) == (once[g]["n"], once[g]["s"])
            mean = sum(values) / len(values)
            assert abs(r["m"] - mean) < 1e-9 and abs(r["d"] - (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5) < 1e-6
            exact = len({u for k, _, u in rows if k == g})
            assert abs(r["u"] - exact) <= 0.07 * exact and 5 <= r["q"] <= 6
            assert r["p"] == once[g]["p"]
        rollup.compact()
    with pytest.raises(ConfigurationError):
        apply_step(whole, {"type": "aggregate", "group_by": "g", "aggregations": {"v": "nothing like it"}})


def test_table_functions_keep_order_and_columns(spark):
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [("a", t(0), 1, "x"), ("a", t(50), None, "x"), ("a", t(10), None, "x"), ("a", None, 5, "x"), ("b", t(0), None, "x"), (None, t(9), 3, "x"), (None, t(99), None, "x")]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v int, row string").repartition(3)
    found = apply_step(df, {"type": "sessions", "partition_by": "k", "order_by": "t", "options": {"column": "t", "gap": 1800}})
    assert found.columns == ["k", "t", "v", "row", "session"]
    assert sorted(((r["k"], r["t"], r["session"]) for r in found.collect()), key=str) == sorted([("a", None, 0), ("a", t(0), 0), ("a", t(10), 0), ("a", t(50), 1), ("b", t(0), 0), (None, t(9), 0), (None, t(99), 1)], key=str)
    filled = apply_step(df.where("t is not null"), {"type": "fill_forward", "partition_by": "k", "order_by": "t", "options": {"column": "v", "kind": "int"}})
    assert sorted(((r["k"], r["v"]) for r in filled.collect()), key=str) == sorted([("a", 1), ("a", 1), ("a", 1), ("b", None), (None, 3), (None, 3)], key=str)
    with pytest.raises(ConfigurationError):
        apply_step(df, {"type": "sessions", "options": {"column": "t", "gap": 1}})


def test_a_table_function_of_ones_own(spark):
    from tidemill.operators.base import STEPS

    try:

        @table_step("running_total_for_test", adds=lambda column: "total double")
        def running(column):
            class Running:
                def __init__(self):
                    self.total = 0.0

                def eval(self, row):
                    self.total += row[column]
                    yield (self.total,)

            return Running

        df = spark.createDataFrame([("a", 2, 2.0), ("a", 1, 1.0), ("b", 1, 5.0)], "k string, i int, v double")
        found = apply_step(df, {"type": "running_total_for_test", "partition_by": "k", "order_by": "i", "options": {"column": "v"}})
        assert sorted((r["k"], r["i"], r["total"]) for r in found.collect()) == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 5.0)]
    finally:
        STEPS._found.pop("running_total_for_test", None)


def test_keys_beyond_the_most_stay_in_a_map(spark, monkeypatch):
    monkeypatch.setattr(shape, "MOST_KEYS", 2)
    df = spark.createDataFrame([({"a": 1, "b": 2, "c": 3},), ({"d": 4},), (None,)], "m map<string,int>")
    rows = apply_step(df, {"type": "flatten"}).collect()
    assert [(r["m.a"], r["m.b"], r["m.rest"]) for r in rows] == [(1, 2, {"c": 3}), (None, None, {"d": 4}), (None, None, None)]


def test_any_spark_format(spark, tmp_path):
    target = {"type": "spark", "format": "orc", "path": str(tmp_path / "o")}
    write_sink(spark.range(5), target | {"compression": "none"})
    assert read_source(spark, target).count() == 5
    assert read_source(spark, target | {"schema": "id long", "mergeSchema": "false"}).columns == ["id"]
