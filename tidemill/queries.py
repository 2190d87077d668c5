"""One query for each operator, over the tables of a folder, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import apply_steps
from tidemill.operators import rules as quality
from tidemill.operators.base import StepContext
from tidemill.plans import extraction
from tidemill.sources import read_source, write_sink

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_source(spark, {"type": "parquet", "path": f"{sf_dir}/{name}.parquet"})


def _query(name: str, sql: str | None = None):
    def add(build):
        _QUERIES[name] = build
        if sql:
            _SQL[name] = sql
        return build

    return add


def _chain(name: str, table: str, steps, sql: str | None) -> None:
    """A query that applies steps to one table; ``steps`` may be a function of (spark, sf_dir)."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        chain = steps(spark, sf_dir) if callable(steps) else steps
        return apply_steps(_table(spark, sf_dir, table), chain, StepContext(execution_id="e1", pipeline_id="p1", task_id="t1", source=table, read=lambda spec: read_source(spark, spec)))

    _query(name, sql)(build)


def _pick(*columns: str) -> dict:
    return {"type": "select", "columns": list(columns)}


# ---- shape --------------------------------------------------------------------------------------

_chain("rename", "nation", [{"type": "rename", "mapping": {"n_nationkey": "n_name", "n_name": "n_nationkey", "none": "x"}}],
       "SELECT n_nationkey AS n_name, n_name AS n_nationkey, n_regionkey FROM nation")
_chain("drop", "customer", [{"type": "drop", "columns": "c_name, c_acctbal, none"}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_chain("select", "customer", [_pick("c_mktsegment", "missing", "c_custkey")], "SELECT c_mktsegment, NULL::VARCHAR AS missing, c_custkey FROM customer")
_chain("normalize_columns", "region", [{"type": "rename", "mapping": {"r_regionkey": "  Région   Key ", "r_name": "regionName"}}, {"type": "normalize_columns"}],
       "SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
_chain("add_column", "region", [{"type": "add_column", "column": "origin", "value": "${pipeline_id}/${task_id}"}, {"type": "add_column", "column": "n", "value": 7}, {"type": "add_column", "column": "n", "value": 8, "overwrite": False}],
       "SELECT r_regionkey, r_name, 'p1/t1' AS origin, 7::INT AS n FROM region")
_chain("split_column", "customer", [_pick("c_custkey", "c_name"), {"type": "split_column", "column": "c_name", "separator": "#", "into": ["prefix", "number", "none"]}],
       "SELECT c_custkey, trim(split_part(c_name, '#', 1)) AS prefix, CASE WHEN contains(c_name, '#') THEN trim(split_part(c_name, '#', 2)) END AS number, NULL::VARCHAR AS none FROM customer")
_chain("concat_columns", "customer", [{"type": "derive", "column": "maybe", "expression": "c_mktsegment if c_custkey % 3 == 0 else None"}, {"type": "concat_columns", "columns": ["c_name", "maybe", "c_custkey"], "target": "label", "separator": "-"}, {"type": "concat_columns", "columns": ["maybe", "c_nationkey"], "target": "full", "skip_null": False}, _pick("c_custkey", "label", "full")],
       "SELECT c_custkey, concat_ws('-', c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_custkey) AS label, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'None') || ' ' || c_nationkey AS \"full\" FROM customer")
_chain("add_metadata_row_number", "orders", [_pick("o_orderkey"), {"type": "add_metadata", "include": "row_number, batch, pipeline_id", "order_by": "o_orderkey"}],
       "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS _row_number, ((row_number() OVER (ORDER BY o_orderkey)) - 1) // 10000 AS _batch, 'p1' AS _pipeline_id FROM orders")


@_query("flatten_json", "SELECT event_id, (props->>'$.k')::BIGINT AS \"props.k\" FROM events")
def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return apply_steps(events, [{"type": "flatten"}])


# ---- values -------------------------------------------------------------------------------------

_chain("derive_arith", "lineitem", [{"type": "derive", "column": "net", "expression": "l_extendedprice * (1 - l_discount)"}, {"type": "derive", "column": "halves", "expression": "l_linenumber // 2 + (0 - l_linenumber) % 3"}, {"type": "derive", "column": "per", "expression": "l_quantity / (l_linenumber - 1)"}, _pick("l_orderkey", "l_linenumber", "net", "halves", "per")],
       "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber // 2 + ((3 - l_linenumber % 3) % 3)::BIGINT AS halves, l_quantity / nullif(l_linenumber - 1, 0) AS per FROM lineitem")
_chain("derive_case", "orders", [{"type": "derive", "column": "size", "expression": "'big' if o_totalprice > 200000 else 'mid' if 100000 < o_totalprice <= 200000 else 'small'"}, {"type": "derive", "column": "urgent", "expression": "o_orderpriority in ['1-URGENT', '2-HIGH'] and not startswith(o_orderstatus, 'F')"}, _pick("o_orderkey", "size", "urgent")],
       "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT starts_with(o_orderstatus, 'F') AS urgent FROM orders")
_chain("derive_null_safe", "customer", [{"type": "derive", "column": "maybe", "expression": "c_acctbal if c_custkey % 4 else None"}, {"type": "derive", "column": "same", "expression": "maybe == None"}, {"type": "derive", "column": "more", "expression": "maybe + 1"}, {"type": "derive", "column": "filled", "expression": "default(maybe, 0.0)"}, _pick("c_custkey", "same", "more", "filled")],
       "SELECT c_custkey, m IS NULL AS same, m + 1 AS more, coalesce(m, 0.0) AS filled FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS m FROM customer)")
_chain("derive_functions", "customer", [{"type": "derive", "column": "a", "expression": "upper(replace(c_name, '#', '-')) + str(c_custkey)"}, {"type": "derive", "column": "b", "expression": "len(c_name) + max(c_nationkey, 3) + abs(0 - c_custkey)"}, {"type": "derive", "column": "c", "expression": "join('|', sorted(split(c_mktsegment, 'I')))"}, {"type": "derive", "column": "d", "expression": "c_name[0:3] + slice(c_name, -2)"}, {"type": "derive", "column": "e", "expression": "get({'1': 'one', '2': 'two'}, str(c_nationkey), 'other')"}, {"type": "derive", "column": "f", "expression": "floor(c_acctbal) + ceil(c_acctbal)"}, _pick("c_custkey", "a", "b", "c", "d", "e", "f")],
       "SELECT c_custkey, upper(replace(c_name, '#', '-')) || c_custkey AS a, (length(c_name) + greatest(c_nationkey, 3) + c_custkey)::BIGINT AS b, array_to_string(list_sort(string_split(c_mktsegment, 'I')), '|') AS c, left(c_name, 3) || right(c_name, 2) AS d, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS e, (floor(c_acctbal) + ceil(c_acctbal))::BIGINT AS f FROM customer")
_chain("derive_dates", "orders", [{"type": "derive", "column": "y", "expression": "year(o_orderdate) * 100 + month(o_orderdate)"}, {"type": "derive", "column": "age", "expression": "days_between('2000-01-01', o_orderdate)"}, {"type": "derive", "column": "shown", "expression": "date_format(o_orderdate, '%d/%m/%Y')"}, _pick("o_orderkey", "y", "age", "shown")],
       "SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS y, floor((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 86400000000)::BIGINT AS age, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders")
_chain("cast", "customer", [{"type": "derive", "column": "t", "expression": "concat('1,', str(c_custkey), '.9') if c_custkey % 5 else 'bad'"}, {"type": "derive", "column": "u", "expression": "t"}, {"type": "derive", "column": "v", "expression": "'Yes' if c_custkey % 2 else 'off'"}, {"type": "cast", "columns": {"t": "integer", "u": "float", "v": "boolean", "c_nationkey": "string"}}, _pick("c_custkey", "t", "u", "v", "c_nationkey")],
       "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN trunc(('1' || c_custkey || '.9')::DOUBLE)::BIGINT END AS t, CASE WHEN c_custkey % 5 <> 0 THEN ('1' || c_custkey || '.9')::DOUBLE END AS u, c_custkey % 2 <> 0 AS v, c_nationkey::VARCHAR AS c_nationkey FROM customer")
_chain("fill_null", "customer", [{"type": "derive", "column": "a", "expression": "c_name if c_custkey % 2 else '  '"}, {"type": "derive", "column": "b", "expression": "c_acctbal if c_custkey % 3 else None"}, {"type": "fill_null", "columns": {"a": "unknown", "b": 0.0, "c": "new"}}, _pick("c_custkey", "a", "b", "c")],
       "SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 THEN c_name ELSE 'unknown' END AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal ELSE 0.0 END AS b, 'new' AS c FROM customer")
_chain("map_values", "orders", [{"type": "map_values", "column": "o_orderstatus", "mapping": {"O": "open", "F": "finished"}}, {"type": "map_values", "column": "o_orderpriority", "mapping": {"1-URGENT": "now"}, "default": "later", "target": "due"}, _pick("o_orderkey", "o_orderstatus", "due")],
       "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE 'later' END AS due FROM orders")
_chain("string_ops", "part", [{"type": "derive", "column": "x", "expression": "'  ' + p_name + '   É1 '"}, {"type": "string_ops", "columns": "x", "operations": "collapse_spaces, upper, remove_accents", "max_length": 12}, {"type": "string_ops", "columns": "p_brand", "operations": ["digits_only"]}, _pick("p_partkey", "x", "p_brand")],
       "SELECT p_partkey, left(strip_accents(upper(trim(regexp_replace('  ' || p_name || '   É1 ', '\\s+', ' ', 'g')))), 12) AS x, regexp_replace(p_brand, '\\D', '', 'g') AS p_brand FROM part")
_chain("parse_date", "orders", [{"type": "derive", "column": "d", "expression": "date_format(o_orderdate, '%d/%m/%Y') if o_orderkey % 2 else date_format(o_orderdate, '%Y%m%d')"}, {"type": "derive", "column": "e", "expression": "d if o_orderkey % 3 else 'none'"}, {"type": "parse_date", "columns": "d", "output_format": "%Y-%m-%d"}, {"type": "parse_date", "columns": "e"}, _pick("o_orderkey", "d", "e")],
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS e FROM orders")
_chain("convert_timezone", "events", [_pick("event_id", "ts"), {"type": "convert_timezone", "columns": "ts", "from": "+02:00", "to": "UTC"}],
       "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS ts FROM events")
_chain("convert_currency", "orders", [{"type": "derive", "column": "cur", "expression": "'usd' if o_orderkey % 2 else 'XXX'"}, {"type": "derive", "column": "amount", "expression": "float(o_orderkey)"}, {"type": "convert_currency", "columns": "amount", "rates": {"USD": 0.9}, "currency_column": "cur"}, _pick("o_orderkey", "amount")],
       "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN (o_orderkey::DECIMAL(18,2) * 0.9)::DOUBLE ELSE o_orderkey::DOUBLE END AS amount FROM orders")

# ---- privacy ------------------------------------------------------------------------------------

_chain("hash_columns", "customer", [_pick("c_custkey", "c_name"), {"type": "hash_columns", "columns": "c_name", "target_suffix": "_hash", "keep_original": True}],
       "SELECT c_custkey, c_name, sha256(c_name) AS c_name_hash FROM customer")
_chain("mask_email", "customer", [{"type": "derive", "column": "mail", "expression": "lower(replace(c_name, '#', '.')) + '@corp.com'"}, {"type": "mask_pii", "columns": "mail"}, _pick("c_custkey", "mail")],
       "SELECT c_custkey, left(lower(c_name), 1) || repeat('*', length(c_name) - 1) || '@corp.com' AS mail FROM customer")
_chain("mask_partial", "customer", [{"type": "mask_pii", "columns": "c_name", "strategy": "partial", "keep_start": 2, "keep_end": 3}, _pick("c_custkey", "c_name")],
       "SELECT c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3) AS c_name FROM customer")
_chain("mask_card", "customer", [{"type": "derive", "column": "card", "expression": "'4111 1111 1111 1111'"}, {"type": "mask_pii", "columns": "card"}, _pick("c_custkey", "card")],
       "SELECT c_custkey, '************1111' AS card FROM customer")
_chain("encrypt_columns", "customer", [_pick("c_custkey", "c_name"), {"type": "encrypt_columns", "columns": "c_name", "key": "example"}], None)

# ---- relational ---------------------------------------------------------------------------------

_chain("filter", "lineitem", [{"type": "filter", "expression": "l_quantity > 45 and l_returnflag != 'N'"}, _pick("l_orderkey", "l_linenumber", "l_quantity")],
       "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag <> 'N'")
_chain("filter_invert", "orders", [{"type": "filter", "expression": "o_orderstatus == 'O'", "invert": True}, _pick("o_orderkey")],
       "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'")
_chain("limit", "orders", [{"type": "limit", "count": 25, "order_by": "o_orderkey"}, _pick("o_orderkey", "o_custkey")],
       "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
_chain("sort", "supplier", [{"type": "sort", "columns": ["s_nationkey", "s_acctbal desc", "s_suppkey"]}, {"type": "limit", "count": 40}], "SELECT * FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 40")
_chain("sort_all", "orders", [{"type": "sort", "columns": "o_totalprice desc, o_orderkey"}, _pick("o_orderkey", "o_totalprice")], "SELECT o_orderkey, o_totalprice FROM orders")
_chain("sort_desc_nulls", "customer", [{"type": "derive", "column": "k", "expression": "c_nationkey if c_custkey % 7 else None"}, {"type": "sort", "columns": "k desc, c_custkey"}, {"type": "limit", "count": 300}, _pick("k", "c_custkey")],
       "SELECT k, c_custkey FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS k, c_custkey FROM customer) ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 300")
_chain("deduplicate_first", "orders", [{"type": "deduplicate", "columns": "o_custkey", "order_by": "o_orderdate, o_orderkey"}, _pick("o_custkey", "o_orderkey")],
       "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
_chain("deduplicate_last", "orders", [{"type": "deduplicate", "columns": "o_custkey", "keep": "last", "order_by": "o_orderdate desc, o_orderkey"}, _pick("o_custkey", "o_orderkey")],
       "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey DESC) = 1")
_chain("deduplicate_rows", "lineitem", [_pick("l_suppkey", "l_returnflag"), {"type": "deduplicate"}], "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
_chain("dedupe_batch", "orders", [_pick("o_orderkey", "o_custkey"), {"type": "dedupe_batch", "columns": "o_custkey", "order_by": "o_orderkey"}],
       "SELECT o_orderkey, o_custkey FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10000 AS b FROM orders) QUALIFY row_number() OVER (PARTITION BY b, o_custkey ORDER BY o_orderkey) = 1")


def _lookup(spark: SparkSession, sf_dir: str) -> dict:
    return {"type": "parquet", "path": f"{sf_dir}/nation.parquet"}


_chain("join_left", "customer", lambda s, d: [{"type": "derive", "column": "k", "expression": "c_nationkey if c_custkey % 2 else None"}, {"type": "join", "source": _lookup(s, d), "left_on": "k", "right_on": "n_nationkey", "columns": "n_name"}, _pick("c_custkey", "n_name")],
       "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_custkey % 2 <> 0 AND c_nationkey = n_nationkey")
_chain("join_inner", "customer", lambda s, d: [{"type": "filter", "expression": "c_custkey > 10"}, {"type": "join", "source": _lookup(s, d), "left_on": "c_nationkey", "right_on": "n_nationkey", "how": "inner", "prefix": "x_"}, _pick("c_custkey", "x_n_name", "x_n_regionkey")],
       "SELECT c_custkey, n_name AS x_n_name, n_regionkey AS x_n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey > 10")
_chain("join_first_match", "customer", lambda s, d: [{"type": "join", "source": {"type": "parquet", "path": f"{d}/orders.parquet"}, "left_on": "c_custkey", "right_on": "o_custkey", "columns": "o_orderkey", "order_by": "o_orderkey"}, _pick("c_custkey", "o_orderkey")],
       "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
_chain("join_semi", "customer", lambda s, d: [{"type": "join", "source": {"type": "parquet", "path": f"{d}/orders.parquet"}, "left_on": "c_custkey", "right_on": "o_custkey", "how": "semi"}, _pick("c_custkey")],
       "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_chain("join_anti", "customer", lambda s, d: [{"type": "join", "source": {"type": "parquet", "path": f"{d}/orders.parquet"}, "left_on": "c_custkey", "right_on": "o_custkey", "how": "anti"}, _pick("c_custkey")],
       "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_chain("aggregate", "lineitem", [{"type": "aggregate", "group_by": "l_returnflag, l_linestatus", "aggregations": {"qty": {"column": "l_quantity", "function": "sum"}, "mean_qty": {"column": "l_quantity", "function": "avg"}, "n": {"column": "l_orderkey", "function": "count"}, "parts": {"column": "l_partkey", "function": "count_distinct"}, "low": {"column": "l_extendedprice", "function": "min"}, "high": {"column": "l_shipdate", "function": "max"}}}],
       "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 10) AS qty, round(avg(l_quantity), 10) AS mean_qty, count(l_orderkey) AS n, count(DISTINCT l_partkey) AS parts, min(l_extendedprice) AS low, max(l_shipdate) AS high FROM lineitem GROUP BY 1, 2")
_chain("aggregate_global", "orders", [{"type": "aggregate", "aggregations": {"o_orderkey": "count", "o_custkey": "count_distinct"}}], "SELECT count(o_orderkey) AS o_orderkey, count(DISTINCT o_custkey) AS o_custkey FROM orders")
_chain("aggregate_empty", "orders", [{"type": "filter", "expression": "o_orderkey < 0"}, {"type": "aggregate", "aggregations": {"o_orderkey": "count"}}], "SELECT count(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0")
_chain("aggregate_ordered", "orders", [{"type": "aggregate", "group_by": "o_custkey", "order_by": "o_orderkey", "aggregations": {"f": {"column": "o_orderstatus", "function": "first"}, "l": {"column": "o_orderkey", "function": "last"}, "c": {"column": "o_orderkey", "function": "concat"}, "items": {"column": "o_orderkey", "function": "list"}}}, {"type": "derive", "column": "items", "expression": "len(items)"}],
       "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS f, max(o_orderkey) AS l, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS c, count(*) AS items FROM orders GROUP BY 1")

# ---- validation ---------------------------------------------------------------------------------


def _rule(name: str, table: str, prepare: list[dict], rules: list[dict], key: str, sql: str) -> None:
    @_query(name, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = apply_steps(_table(spark, sf_dir, table), prepare)
        found = quality.checked(df, rules)
        return found.select(key, F.size("_violations").cast("long").alias("violations"))


_rule("rule_not_null", "customer", [{"type": "derive", "column": "x", "expression": "c_name if c_custkey % 3 else ' '"}], [{"type": "not_null", "field": "x"}], "c_custkey",
      "SELECT c_custkey, (c_custkey % 3 = 0)::BIGINT AS violations FROM customer")
_rule("rule_required_columns", "region", [], [{"type": "required_columns", "columns": ["r_name", "zz"]}], "r_regionkey", "SELECT r_regionkey, 1::BIGINT AS violations FROM region")
_rule("rule_type", "customer", [{"type": "derive", "column": "x", "expression": "'12' if c_custkey % 3 == 0 else '1.5' if c_custkey % 3 == 1 else None"}], [{"type": "type", "field": "x", "expected": "integer"}], "c_custkey",
      "SELECT c_custkey, (c_custkey % 3 = 1)::BIGINT AS violations FROM customer")
_rule("rule_range", "orders", [], [{"type": "range", "field": "o_totalprice", "min": 50000, "max": 200000}], "o_orderkey",
      "SELECT o_orderkey, (o_totalprice < 50000 OR o_totalprice > 200000)::BIGINT AS violations FROM orders")
_rule("rule_length", "part", [], [{"type": "length", "field": "p_name", "min": 12, "max": 20}], "p_partkey",
      "SELECT p_partkey, (length(p_name) < 12 OR length(p_name) > 20)::BIGINT AS violations FROM part")
_rule("rule_regex", "customer", [], [{"type": "regex", "field": "c_name", "pattern": ".*[0-4]"}], "c_custkey",
      "SELECT c_custkey, (NOT regexp_full_match(c_name, '.*[0-4]'))::BIGINT AS violations FROM customer")
_rule("rule_email", "customer", [{"type": "derive", "column": "x", "expression": "'a@b.com' if c_custkey % 2 else 'a@b@c'"}], [{"type": "email", "field": "x"}], "c_custkey",
      "SELECT c_custkey, (c_custkey % 2 = 0)::BIGINT AS violations FROM customer")
_rule("rule_uuid", "customer", [{"type": "derive", "column": "x", "expression": "'123e4567-e89b-12d3-a456-426614174000' if c_custkey % 2 else '123'"}], [{"type": "uuid", "field": "x"}], "c_custkey",
      "SELECT c_custkey, (c_custkey % 2 = 0)::BIGINT AS violations FROM customer")
_rule("rule_date_format", "orders", [], [{"type": "date_format", "field": "o_orderdate", "min_date": "1994-01-01", "max_date": "1997-01-01"}], "o_orderkey",
      "SELECT o_orderkey, (o_orderdate < TIMESTAMP '1994-01-01' OR o_orderdate > TIMESTAMP '1997-01-01')::BIGINT AS violations FROM orders")
_rule("rule_in_set", "orders", [], [{"type": "in_set", "field": "o_orderstatus", "values": ["o", "f"], "case_sensitive": False}], "o_orderkey",
      "SELECT o_orderkey, (o_orderstatus NOT IN ('O', 'F'))::BIGINT AS violations FROM orders")
_rule("rule_unique", "orders", [], [{"type": "unique", "field": "o_custkey", "order_by": "o_orderkey"}], "o_orderkey",
      "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1)::BIGINT AS violations FROM orders")
_rule("rule_expression", "orders", [], [{"type": "expression", "expression": "o_totalprice > 1000 * (o_orderkey % 100)"}], "o_orderkey",
      "SELECT o_orderkey, (NOT o_totalprice > 1000 * (o_orderkey % 100))::BIGINT AS violations FROM orders")
_rule("rule_comparison", "lineitem", [{"type": "derive", "column": "k", "expression": "l_orderkey * 10 + l_linenumber"}], [{"type": "comparison", "left": "l_partkey", "right": "l_suppkey", "operator": ">"}], "k",
      "SELECT l_orderkey * 10 + l_linenumber AS k, (NOT l_partkey > l_suppkey)::BIGINT AS violations FROM lineitem")
_rule("rule_sequence", "orders", [], [{"type": "sequence", "field": "o_custkey", "order_by": "o_orderkey"}], "o_orderkey",
      "SELECT o_orderkey, coalesce(o_custkey < max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)::BIGINT AS violations FROM orders")


@_query("rule_schema_block", "SELECT s_suppkey, ((s_acctbal < 0)::INT + (length(s_name) > 17)::INT)::BIGINT AS violations FROM supplier")
def rule_schema_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"s_suppkey": {"type": "integer", "nullable": False, "unique": True}, "s_acctbal": {"type": "float", "min": 0}, "s_name": {"max_length": 17}}
    found = quality.checked(_table(spark, sf_dir, "supplier").withColumn("_ordinal", F.col("s_suppkey")), [], schema)
    return found.select("s_suppkey", F.size("_violations").cast("long").alias("violations"))


@_query("quarantine", "SELECT o_orderkey, '[range] above 300000; [in_set] not an allowed value' AS _violations FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, '[range] above 300000' FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O' UNION ALL SELECT o_orderkey, '[in_set] not an allowed value' FROM orders WHERE o_totalprice <= 300000 AND o_orderstatus <> 'O'")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"type": "range", "field": "o_totalprice", "max": 300000}, {"type": "in_set", "field": "o_orderstatus", "values": ["O"]}, {"type": "length", "field": "o_orderpriority", "max": 1, "severity": "warning"}]
    _, bad, _ = quality.split(quality.checked(_table(spark, sf_dir, "orders"), rules), "quarantine")
    return bad.select("o_orderkey", "_violations")


# ---- sources, extraction, streams --------------------------------------------------------------


@_query("generator")
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, {"type": "generator", "rows": 1000, "seed": 7})


@_query("incremental", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' - INTERVAL 3600 SECOND")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.since(_table(spark, sf_dir, "orders"), "o_orderdate", "1997-06-01", overlap=3600).select("o_orderkey", "o_orderdate")


@_query("cdc_first_delivered", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def cdc_first_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.first_changes(_table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


def _round_trip(kind: str, name: str, sql: str, **read_options) -> None:
    @_query(name, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        import uuid

        from tidemill.plans.staging import staging_dir

        path = f"{staging_dir(spark)}/trips/{uuid.uuid4().hex}.{kind}"
        rows = _table(spark, sf_dir, "nation")
        write_sink(rows, {"type": kind, "path": path, "mode": "overwrite"})
        back = read_source(spark, {"type": kind, "path": path, **read_options})
        return back.select(F.col("n_nationkey").cast("double").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("double").cast("int").alias("n_regionkey"))


for _kind, _options in (("csv", {}), ("json", {"format": "lines"}), ("xml", {"record_tag": "record"}), ("parquet", {}), ("excel", {})):
    _round_trip(_kind, f"{_kind}_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation", **_options)


@_query("inline", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2::BIGINT, NULL)) AS t(id, name)")
def inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, {"type": "inline", "records": [{"id": 1, "name": "a"}, {"id": 2}]})


# ---- further functions and constructs ---------------------------------------------------------


def _derived(name: str, table: str, key: str, made: dict[str, str], sql: str) -> None:
    _chain(name, table, [*({"type": "derive", "column": c, "expression": e} for c, e in made.items()), _pick(key, *made)], sql)


_derived("fn_numbers", "customer", "c_custkey",
         {"a": "min(c_nationkey, 3)", "b": "sum([c_nationkey, 1, 2])", "c": "round(c_nationkey / 2)", "d": "sqrt(abs(c_acctbal))", "e": "pow(c_nationkey, 2)", "f": "int(c_acctbal)", "g": "float(decimal(str(c_custkey)) + 1)", "h": "round(c_acctbal, 1)"},
         "SELECT c_custkey, least(c_nationkey, 3)::BIGINT AS a, (c_nationkey + 3)::BIGINT AS b, round_even(c_nationkey / 2, 0) AS c, sqrt(abs(c_acctbal)) AS d, pow(c_nationkey, 2)::DOUBLE AS e, trunc(c_acctbal)::BIGINT AS f, (c_custkey + 1)::DOUBLE AS g, round_even(c_acctbal::DECIMAL(18,4), 1)::DOUBLE AS h FROM customer")
_derived("fn_text", "customer", "c_custkey",
         {"a": "strip('  ' + c_name + ' ')", "b": "endswith(c_name, '1')", "c": "contains(c_mktsegment, 'U')", "d": "regex_match('.*[0-4]$', c_name)", "e": "strip(c_mktsegment, 'AE')"},
         "SELECT c_custkey, c_name AS a, ends_with(c_name, '1') AS b, contains(c_mktsegment, 'U') AS c, regexp_matches(c_name, '[0-4]$') AS d, trim(c_mktsegment, 'AE') AS e FROM customer")
_derived("fn_nulls", "customer", "c_custkey",
         {"m": "c_name if c_custkey % 3 else None", "a": "coalesce(m, c_mktsegment)", "b": "is_null(m)", "c": "is_not_null(m)", "d": "bool(c_nationkey)", "e": "m is None"},
         "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS m, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_mktsegment END AS a, c_custkey % 3 = 0 AS b, c_custkey % 3 <> 0 AS c, c_nationkey <> 0 AS d, c_custkey % 3 = 0 AS e FROM customer")
_derived("fn_dates", "orders", "o_orderkey",
         {"a": "day(o_orderdate)", "b": "days_between(date_parse(date_format(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d'), '1990-01-01')"},
         "SELECT o_orderkey, day(o_orderdate)::BIGINT AS a, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS b FROM orders")
_derived("fn_collections", "customer", "c_custkey",
         {"a": "join('|', keys({'x': c_custkey, 'y': 1}))", "b": "sum(values({'x': c_custkey, 'y': 1}))", "c": "any([c_nationkey > 20, c_custkey % 2 == 0])", "d": "all([c_nationkey > 5, c_custkey % 2 == 0])", "e": "max(sorted([c_custkey, 7], True))"},
         "SELECT c_custkey, 'x|y' AS a, (c_custkey + 1)::BIGINT AS b, c_nationkey > 20 OR c_custkey % 2 = 0 AS c, c_nationkey > 5 AND c_custkey % 2 = 0 AS d, greatest(c_custkey, 7)::BIGINT AS e FROM customer")
_derived("constructs", "customer", "c_custkey",
         {"a": "c_nationkey ** 2", "b": "{'p': {'q': c_nationkey}}.p.q", "c": "is_null(nothing_of_this_name)", "d": "c_mktsegment is None"},
         "SELECT c_custkey, (c_nationkey * c_nationkey)::BIGINT AS a, c_nationkey AS b, NULL::BOOLEAN AS c, false AS d FROM customer")

# ---- databases, memory, drift, whole pipelines ------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from tidemill.plans.staging import staging_dir

    return f"{staging_dir(spark)}/trips/{name}-{uuid.uuid4().hex}"


def _database(spark: SparkSession) -> str:
    """A new SQLite file in the shared folder."""
    import os

    path = _scratch(spark, "db").removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


@_query("sql_where", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey < 200 AND o_totalprice > 1000.5")
def sql_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is loaded into a database and read back by a condition and columns."""
    db = {"type": "sqlite", "database": _database(spark), "table": "o"}
    orders = apply_steps(_table(spark, sf_dir, "orders"), [{"type": "derive", "column": "o_orderstatus", "expression": "o_orderstatus if o_orderkey % 2 == 0 else None"}])
    write_sink(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), db | {"create_table": True})
    return read_source(spark, db | {"columns": "o_orderkey, o_totalprice, o_orderstatus", "where": "o_custkey < 200 AND o_totalprice > 1000.5"})


@_query("sql_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 3")
def sql_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that exist are replaced by key, others added."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name")
    db = {"type": "sqlite", "database": _database(spark), "table": "n", "key_columns": "n_nationkey"}
    write_sink(nation, db | {"create_table": True})
    new = nation.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name"))
    write_sink(new.unionAll(nation.where("n_nationkey < 3").select(F.col("n_nationkey") + 100, "n_name")), db | {"mode": "upsert"})
    return read_source(spark, {k: v for k, v in db.items() if k != "key_columns"})


@_query("sql_query", "SELECT o_orderstatus, count(*) AS n, CASE WHEN count(*) > 0 THEN 0.5 END AS half FROM orders WHERE o_custkey < 500 GROUP BY 1")
def sql_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a bound parameter runs in the database."""
    db = {"type": "sqlite", "database": _database(spark)}
    write_sink(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), db | {"table": "o", "create_table": True})
    return read_source(spark, db | {"query": "SELECT o_orderstatus, count(*) AS n, 0.5 AS half FROM o WHERE o_custkey < :most GROUP BY 1", "params": {"most": 500}})


@_query("sql_without_rowid", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def sql_without_rowid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that has no row ids is read by ranges of its primary key."""
    import sqlite3

    path = _database(spark)
    with sqlite3.connect(path) as link:
        link.execute("CREATE TABLE o (o_orderpriority TEXT, o_orderkey INTEGER, o_totalprice REAL, PRIMARY KEY (o_orderpriority, o_orderkey)) WITHOUT ROWID")
    db = {"type": "sqlite", "database": path, "table": "o"}
    write_sink(_table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), db)
    return read_source(spark, db | {"num_partitions": 6})


@_query("sql_view", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view is read by ranges of the column that has the most values."""
    import sqlite3

    path = _database(spark)
    db = {"type": "sqlite", "database": path}
    write_sink(_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), db | {"table": "o", "create_table": True})
    with sqlite3.connect(path) as link:
        link.execute("CREATE VIEW by_customer AS SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM o GROUP BY o_custkey")
    return read_source(spark, db | {"table": "by_customer", "num_partitions": 6, "snapshot": True})


@_query("csv_orders_round_trip", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def csv_orders_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "orders")
    write_sink(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), {"type": "csv", "path": path})
    return read_source(spark, {"type": "csv", "path": path})


@_query("csv_multiline_ranges", "SELECT doc_id::VARCHAR AS doc_id, nullif(text, '') AS text, lang, source FROM documents")
def csv_multiline_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many lines and quotes as cells; each part file is read by several tasks."""
    path = _scratch(spark, "texts")
    write_sink(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), {"type": "csv", "path": path, "escape_formulas": False})
    return read_source(spark, {"type": "csv", "path": path, "range_bytes": 1 << 18, "strip_whitespace": False, "null_values": [""]})


@_query("json_array_ranges", "SELECT doc_id, text, lang, source FROM documents")
def json_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON arrays, each of which several tasks read."""
    path = _scratch(spark, "arrays")
    write_sink(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), {"type": "json", "path": path, "format": "array"})
    return read_source(spark, {"type": "json", "path": path, "range_bytes": 1 << 18})


@_query("csv_skip_rows", "SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation UNION ALL SELECT 'key', 'name'")
def csv_skip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines before the header go, and a row that reads like the header stays."""
    path = _scratch(spark, "skip")
    rows = _table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"), F.col("n_nationkey").cast("long").alias("at"))
    head = spark.createDataFrame([("made by hand", -4), ("in two lines", -3), ("key,name", -2), ("key,name", -1)], "value string, at long")
    head.unionAll(rows).orderBy("at").select("value").coalesce(1).write.text(path)
    return read_source(spark, {"type": "csv", "path": path, "skip_rows": 2})


@_query("memory_append", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")
def memory_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    name = f"regions{uuid.uuid4().hex}"
    regions = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    write_sink(regions, {"type": "memory", "dataset": name})
    write_sink(regions.where("r_regionkey > 2"), {"type": "memory", "dataset": name, "mode": "append"})
    return read_source(spark, {"type": "memory", "dataset": name})


@_query("null_sink", "SELECT count(*) AS n FROM orders")
def null_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(write_sink(_table(spark, sf_dir, "orders"), {"type": "null"}),)], "n long")


@_query("generator_ids", "SELECT range + 1 AS id FROM range(1000)")
def generator_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, {"type": "generator", "rows": 1000, "columns": "id"})


@_query("encrypt_round_trip", "SELECT c_custkey, c_name FROM customer")
def encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What encrypting hides, the key brings back."""
    from tidemill.operators.privacy import decrypt

    hidden = apply_steps(_table(spark, sf_dir, "customer"), [_pick("c_custkey", "c_name"), {"type": "encrypt_columns", "columns": "c_name", "key": "example"}])
    some = hidden.where("c_name is not null").first()
    salt = some["c_name"].split(":")[1] if some else ""
    return hidden.select("c_custkey", decrypt(F.col("c_name"), "example", salt).alias("c_name"))


@_query("schema_drift", "SELECT * FROM (VALUES ('added', 'n_comment'), ('changed', 'n_regionkey'), ('removed', 'n_old')) AS t(what, name)")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _table(spark, sf_dir, "nation").withColumn("n_old", F.lit(1)).withColumn("n_regionkey", F.lit("1"))
    after = _table(spark, sf_dir, "nation").withColumn("n_comment", F.lit("x"))
    found = extraction.drift(extraction.described(before), extraction.described(after))
    return spark.createDataFrame([(k, c) for k, names in found.items() for c in names], "what string, name string")


def _ran(spark: SparkSession, tasks: list[dict], **options):
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline
    from tidemill.plans.state import StateStore

    return Runner(spark, StateStore(spark, _scratch(spark, "state"))).run(parse_pipeline({"name": "p", "tasks": tasks} | options))


@_query("pipeline_outputs", "SELECT o_orderkey, 'kept' AS output FROM orders WHERE o_totalprice <= 200000 UNION ALL SELECT o_orderkey, 'rejected' FROM orders WHERE o_totalprice > 200000")
def pipeline_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline that checks before it transforms, and publishes kept and rejected rows."""
    out = _scratch(spark, "outputs")
    task = {"id": "load", "source": {"type": "parquet", "path": f"{sf_dir}/orders.parquet"}, "transformations": [_pick("o_orderkey")],
            "validation": {"stage": "pre_transform", "on_failure": "quarantine", "max_errors": 1 << 40, "rules": [{"type": "range", "field": "o_totalprice", "max": 200000}]},
            "destination": {"type": "parquet", "path": f"{out}/kept"}, "rejects": {"type": "parquet", "path": f"{out}/rejected"}}
    _ran(spark, [task])
    kept, bad = (read_source(spark, {"type": "parquet", "path": f"{out}/{x}"}).select("o_orderkey", F.lit(x).alias("output")) for x in ("kept", "rejected"))
    return kept.unionAll(bad)


@_query("pipeline_statuses", """SELECT * FROM (VALUES ('a', 'success', (SELECT count(*) FROM region)), ('b', 'failed', 0), ('c', 'blocked', 0), ('d', 'skipped', 0),
    ('e', 'success', (SELECT count(*) FROM nation)), ('f', 'success', 0)) AS t(task, status, rows_out)""")
def pipeline_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies, failures that go on, conditions over earlier counts, limits on errors, tasks without work."""
    source = lambda t: {"type": "parquet", "path": f"{sf_dir}/{t}.parquet"}
    null = {"type": "null"}
    tasks = [
        {"id": "a", "source": source("region"), "destination": null},
        {"id": "b", "depends_on": ["a"], "on_failure": "continue", "source": source("nation"), "destination": null, "validation": {"on_failure": "drop", "max_errors": 3, "rules": [{"type": "range", "field": "n_nationkey", "max": 10}]}},
        {"id": "c", "depends_on": ["b"], "source": source("nation"), "destination": null},
        {"id": "d", "depends_on": ["a"], "condition": "state.a.rows_out > 1000", "source": source("nation"), "destination": null},
        {"id": "e", "depends_on": ["a"], "condition": "state.a.rows_out < 1000", "source": source("nation"), "destination": null},
        {"id": "f", "type": "noop", "depends_on": ["e"]},
    ]
    done = _ran(spark, tasks).tasks
    return spark.createDataFrame([(r.id, r.status, r.rows_out) for r in done.values()], "task string, status string, rows_out long")


@_query("incremental_runs", "SELECT * FROM (VALUES (1, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')), (2, 0), (3, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'))) AS t(run, rows_out)")
def incremental_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of one task: the first takes what is there, the second finds nothing new, the third what came since."""
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline
    from tidemill.plans.state import StateStore

    path, state = _scratch(spark, "orders"), StateStore(spark, _scratch(spark, "state"))
    task = {"id": "t", "source": {"type": "parquet", "path": path}, "extraction": {"mode": "incremental", "column": "o_orderdate", "drift": "strict"}, "destination": {"type": "null"}}
    orders, counts = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), []
    for part in ("o_orderdate < timestamp_ntz '1996-01-01'", None, "o_orderdate >= timestamp_ntz '1996-01-01'"):
        if part:
            orders.where(part).write.mode("append").parquet(path)
        counts.append(Runner(spark, state).run(parse_pipeline({"name": "p", "tasks": [task]})).tasks["t"].rows_out)
    return spark.createDataFrame(list(enumerate(counts, 1)), "run int, rows_out long")


@_query("stream_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows over a stream of files, taken until nothing is left."""
    from tidemill.streaming import incremental as streams

    events = _table(spark, sf_dir, "events")
    name = f"windows_{abs(hash(_scratch(spark, 'w')))}"
    folder = _scratch(spark, "events")
    events.repartition(3).write.parquet(folder)
    stream = streams.file_stream(spark, "parquet", folder, events.schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = streams.windowed(stream, "ts", "1 hour", ["event_type"], delay="3650 days", n=F.count(F.lit(1)))
    query = counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _scratch(spark, "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def _late_events(spark: SparkSession, sf_dir: str):
    """Hourly windows over events that come in three batches, each over the whole time; most rows of the later ones are late."""
    from tidemill.streaming import incremental as streams

    events = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    top = _scratch(spark, "late")
    for part in range(3):  # files come in the order of their times
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{top}/in")
    windows = streams.LateAwareWindows(spark, f"{top}/out", f"{top}/rest", f"{top}/state", "ts", "1 hour", ["event_type"], "2 days", n=F.count(F.lit(1)))
    stream = streams.file_stream(spark, "parquet", f"{top}/in", events.schema, maxFilesPerTrigger=1)
    streams.run_available(stream, f"{top}/check", windows)
    return top


_LATE_SQL = """
    WITH parts AS (SELECT *, event_id % 3 AS part, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ends FROM events),
    marks AS (
        SELECT max(CASE WHEN part = 0 THEN ts END) - INTERVAL 2 DAY AS one, max(CASE WHEN part < 2 THEN ts END) - INTERVAL 2 DAY AS two, max(ts) - INTERVAL 2 DAY AS three
        FROM parts),
    judged AS (SELECT p.*, three, coalesce(ends <= CASE part WHEN 1 THEN one WHEN 2 THEN two END, false) AS late FROM parts p, marks)
"""


@_query("stream_late_windows", _LATE_SQL + "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM judged WHERE NOT late AND ends <= three GROUP BY 1, 2")
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that have ended, without the rows that came too late."""
    found = spark.read.parquet(_late_events(spark, sf_dir) + "/out")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@_query("stream_late_rows", _LATE_SQL + "SELECT event_id, ts, event_type FROM judged WHERE late")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that came too late for their windows."""
    found = spark.read.parquet(_late_events(spark, sf_dir) + "/rest")
    return found.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


@_query("keys_across_runs", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) = 1")
def keys_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change capture over three runs: a customer's first order over all of them."""
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline
    from tidemill.plans.state import StateStore

    top = _scratch(spark, "runs")
    state = StateStore(spark, f"{top}/state")
    for part in range(3):
        _table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == part).select("o_orderkey", "o_custkey").write.parquet(f"{top}/in{part}")
        task = {"id": "t", "source": {"type": "parquet", "path": f"{top}/in{part}"}, "destination": {"type": "parquet", "path": f"{top}/out/part={part}"}}
        task["extraction"] = {"mode": "cdc", "column": "o_orderkey", "key_columns": "o_custkey", "order_by": "o_orderkey", "remember": True}
        state.forget("marks", "keys", "t")  # keys alone tell what is new
        result = Runner(spark, state).run(parse_pipeline({"name": "keys", "tasks": [task]}))
        if result.status != "success":
            raise RuntimeError(result.tasks["t"].error)
    return spark.read.parquet(f"{top}/out").select("o_orderkey", "o_custkey")


@_query("resumed_run", "SELECT c_nationkey, count(*) AS n, count(*) AS again FROM customer GROUP BY 1")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second task fails for want of a table; resuming passes over the first one, whose source is gone by then."""
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline
    from tidemill.plans.state import StateStore
    from tidemill.sources.base import Folder

    top = _scratch(spark, "resume")
    _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").write.parquet(f"{top}/in")
    first = {"id": "a", "source": {"type": "parquet", "path": f"{top}/in"}, "destination": {"type": "parquet", "path": f"{top}/a"}, "transformations": [{"type": "aggregate", "group_by": "c_nationkey", "aggregations": {"n": {"column": "c_custkey", "function": "count"}}}]}
    second = {"id": "b", "depends_on": ["a"], "source": {"type": "parquet", "path": f"{top}/late"}, "destination": {"type": "parquet", "path": f"{top}/b"}}
    runner, spec = Runner(spark, StateStore(spark, f"{top}/state")), parse_pipeline({"name": "resumed", "tasks": [first, second]})
    broken = runner.run(spec)
    Folder(spark, f"{top}/in").delete()
    spark.read.parquet(f"{top}/a").withColumnRenamed("n", "again").write.parquet(f"{top}/late")
    whole = runner.run(spec, resume=True)
    if (broken.status, whole.status, whole.tasks["a"].status) != ("failed", "success", "resumed"):
        raise RuntimeError(f"{broken} {whole}")
    return spark.read.parquet(f"{top}/a").join(spark.read.parquet(f"{top}/b"), "c_nationkey").select("c_nationkey", "n", "again")


@_query("dry_run_counts", "SELECT (SELECT count(*) FROM lineitem)::BIGINT AS rows_in, (SELECT count(*) FROM lineitem WHERE l_quantity > 25)::BIGINT AS rows_out, false AS published")
def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run reads, transforms and counts, and publishes nothing."""
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline
    from tidemill.sources.base import Folder

    target = _scratch(spark, "dry")
    task = {"id": "t", "source": {"type": "parquet", "path": f"{sf_dir}/lineitem.parquet"}, "transformations": [{"type": "filter", "expression": "l_quantity > 25"}], "destination": {"type": "parquet", "path": target}}
    found = Runner(spark).run(parse_pipeline({"name": "dry", "tasks": [task]}), dry_run=True).tasks["t"]
    return spark.createDataFrame([(found.rows_in, found.rows_out, Folder(spark, target).exists())], "rows_in long, rows_out long, published boolean")


@_query("sql_task", "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) > 0 AS paid FROM orders GROUP BY 1")
def sql_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An etl task publishes files, and a SQL task writes what follows from them."""
    from tidemill.plans.runner import Runner
    from tidemill.plans.spec import parse_pipeline

    top = _scratch(spark, "sql")
    load = {"id": "load", "source": {"type": "parquet", "path": f"{sf_dir}/orders.parquet"}, "destination": {"type": "parquet", "path": f"{top}/orders"}}
    text = f"INSERT OVERWRITE DIRECTORY '{top}/out' USING parquet SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) > 0 AS paid FROM parquet.`{top}/orders` GROUP BY 1"
    result = Runner(spark).run(parse_pipeline({"name": "sql", "tasks": [load, {"id": "sum", "type": "sql", "depends_on": ["load"], "statement": text}]}))
    if result.status != "success":
        raise RuntimeError(str(result))
    return spark.read.parquet(f"{top}/out")


@_query("rollup_runs", """
    SELECT o_orderstatus, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean,
        true AS distinct_close, true AS median_close
    FROM orders GROUP BY 1""")
def rollup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored states of three runs, merged; the sketches are held against the exact values, within what they state."""
    from tidemill.plans.rollup import Rollup

    specs = {"n": {"column": "o_orderkey", "function": "count"}, "total": {"column": "o_totalprice"}, "first": {"column": "o_orderdate", "function": "min"}, "most": {"column": "o_totalprice", "function": "max"}}
    specs |= {"mean": {"column": "o_totalprice", "function": "avg"}, "customers": {"column": "o_custkey", "function": "approx_count_distinct"}, "median": {"column": "o_totalprice", "function": "approx_median"}}
    orders = _table(spark, sf_dir, "orders")
    rollup = Rollup(spark, _scratch(spark, "rollup"), "o_orderstatus", specs)
    for part in (0, 1, 2, 1):  # one run is done again
        rollup.add(orders.where(F.col("o_orderkey") % 3 == part), part)
    exact = orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("d"), F.percentile("o_totalprice", F.array(F.lit(0.45), F.lit(0.55))).alias("m"))
    found = rollup.result().join(exact, "o_orderstatus")
    close = F.abs(F.col("customers") - F.col("d")) <= 0.07 * F.col("d")
    return found.select("o_orderstatus", "n", F.round("total", 2).alias("total"), "first", "most", F.round("mean", 4).alias("mean"), close.alias("distinct_close"), F.col("median").between(F.col("m")[0], F.col("m")[1]).alias("median_close"))


@_query("sessions", """
    WITH gaps AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY AS apart FROM events)
    SELECT user_id, event_id, (count(*) FILTER (apart) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS session FROM gaps""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function numbers each user's sessions."""
    step = {"type": "sessions", "partition_by": "user_id", "order_by": "ts, event_id", "options": {"column": "ts", "gap": 86400}}
    return apply_steps(_table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), [step]).drop("ts")


@_query("run_statistics", """
    WITH runs AS (SELECT o_orderpriority AS pipeline, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'success' END AS status,
            o_totalprice AS seconds, o_custkey AS rows_out FROM orders),
    placed AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY seconds) - 1 AS place, count(*) OVER (PARTITION BY pipeline) AS timed FROM runs WHERE seconds > 0)
    SELECT pipeline, count(*) AS runs_total, count(*) FILTER (status = 'success') AS runs_succeeded, round(count(*) FILTER (status = 'success') / count(*), 4) AS success_rate,
        sum(rows_out)::BIGINT AS rows_written, round(avg(seconds), 2) AS avg_seconds, round(max(seconds) FILTER (place = least(timed - 1, floor(timed * 0.95))), 3) AS p95_seconds
    FROM placed GROUP BY 1""")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a history of runs, for which orders stand."""
    from tidemill.plans import state

    runs = _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("pipeline"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'success' END").alias("status"),
        F.col("o_totalprice").alias("seconds"),
        F.lit(0).alias("rows_in"), F.col("o_custkey").alias("rows_out"), F.lit(0).alias("rows_rejected"),
    )
    found = state.run_statistics(runs)
    return found.select("pipeline", "runs_total", "runs_succeeded", "success_rate", "rows_written", F.round("avg_seconds", 2).alias("avg_seconds"), "p95_seconds")


@_query("sales_by_nation", """
    SELECT n_name, round(sum(net), 2) AS revenue, count(l_orderkey) AS n_lines, count(DISTINCT o_custkey) AS customers FROM (
        SELECT n_name, l_orderkey, o_custkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag <> 'R') GROUP BY 1""")
def sales_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship chain: filter, derive, three lookups and an aggregate."""
    parquet = lambda t: {"type": "parquet", "path": f"{sf_dir}/{t}.parquet"}
    steps = [
        {"type": "filter", "expression": "l_returnflag != 'R'"},
        {"type": "derive", "column": "net", "expression": "l_extendedprice * (1 - l_discount)"},
        {"type": "join", "source": parquet("orders"), "left_on": "l_orderkey", "right_on": "o_orderkey", "columns": "o_custkey", "how": "inner"},
        {"type": "join", "source": parquet("customer"), "left_on": "o_custkey", "right_on": "c_custkey", "columns": "c_nationkey", "how": "inner"},
        {"type": "join", "source": parquet("nation"), "left_on": "c_nationkey", "right_on": "n_nationkey", "columns": "n_name", "how": "inner"},
        {"type": "aggregate", "group_by": "n_name", "aggregations": {"revenue": {"column": "net", "function": "sum"}, "n_lines": {"column": "l_orderkey", "function": "count"}, "customers": {"column": "o_custkey", "function": "count_distinct"}}},
    ]
    context = StepContext(read=lambda spec: read_source(spark, spec))
    return apply_steps(_table(spark, sf_dir, "lineitem"), steps, context).withColumn("revenue", F.round("revenue", 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
