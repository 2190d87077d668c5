import sqlite3

import pytest

from tidemill.errors import PublishError
from tidemill.sources import databases
from tidemill.sources.base import read_source, write_sink


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as link:
        # ids far apart, most of them at one end
        ids = [i * i * i for i in range(3000)]
        link.execute("CREATE TABLE sparse (id INTEGER PRIMARY KEY, v TEXT)")
        link.executemany("INSERT INTO sparse VALUES (?, ?)", [(i, f"v{i}") for i in ids])
        link.execute("CREATE TABLE named (k TEXT, n INTEGER, v REAL, PRIMARY KEY (k, n)) WITHOUT ROWID")
        link.executemany("INSERT INTO named VALUES (?, ?, ?)", [(f"k{i % 700}", i, i / 2) for i in range(2000)])
        link.execute("CREATE VIEW seen AS SELECT 'x' AS same, v, n % 900 AS part FROM named UNION ALL SELECT 'x', 1, NULL FROM sparse WHERE id < 1000")
        link.execute("CREATE TABLE mixed (a)")
        link.executemany("INSERT INTO mixed VALUES (?)", [(x,) for x in [None, 1, 2.5, "t", b"b", None, "", 10**12] * 20])
        link.execute("CREATE TABLE blank (a TEXT PRIMARY KEY) WITHOUT ROWID")
    return {"type": "sqlite", "database": path}


def sizes(df):
    return sorted(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


@pytest.mark.parametrize("table", ["sparse", "named", "seen"])
def test_any_table_splits_evenly(spark, db, table):
    with sqlite3.connect(db["database"]) as link:
        want = sorted(link.execute(f"SELECT * FROM {table}").fetchall(), key=repr)  # noqa: S608
    df = read_source(spark, db | {"table": table, "num_partitions": 6})
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
    got = sizes(df)
    assert len(got) == 6 and got[-1] < 0.35 * len(want)


def test_conditions_queries_and_odd_keys(spark, db):
    df = read_source(spark, db | {"table": "named", "where": "n < 1000 OR v > 900", "columns": "n", "num_partitions": 4})
    assert sorted(r["n"] for r in df.collect()) == sorted(n for n in range(2000) if n < 1000 or n / 2 > 900)
    df = read_source(spark, db | {"query": "SELECT n, v FROM named WHERE n >= :least", "params": {"least": 500}, "partition_column": "n", "num_partitions": 5})
    assert sorted(r["n"] for r in df.collect()) == list(range(500, 2000)) and len(sizes(df)) == 5
    df = read_source(spark, db | {"table": "mixed", "partition_column": "a", "num_partitions": 5})
    assert df.count() == 160 and df.where("a IS NULL").count() == 40
    assert read_source(spark, db | {"table": "blank"}).count() == 0
    assert read_source(spark, db | {"table": "named", "order_by": "n desc", "limit": 3}).count() == 3


def test_all_tasks_read_one_state(spark, db):
    live = read_source(spark, db | {"table": "sparse", "num_partitions": 3})
    copy = read_source(spark, db | {"table": "sparse", "num_partitions": 3, "snapshot": True})
    assert live.count() == copy.count() == 3000
    with sqlite3.connect(db["database"]) as link:
        link.execute("DELETE FROM sparse WHERE id > 100")
    with pytest.raises(Exception, match="changed while it was read"):
        live.count()
    assert copy.count() == 3000


def test_a_failed_merge_leaves_no_staging_table(spark, tmp_path):
    at = {"type": "sql", "dsn": f"jdbc:derby:{tmp_path}/d;create=true", "table": "T"}
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "ID long, NAME string")
    try:
        write_sink(rows, at)
    except Exception:
        pytest.skip("no Derby here")
    twice = spark.createDataFrame([(1, "c"), (1, "d"), (3, "e"), (None, "f"), (None, "g")], "ID long, NAME string").coalesce(1)
    write_sink(twice, at | {"mode": "upsert", "key_columns": "ID"})
    assert sorted(tuple(r) for r in read_source(spark, at).where("ID IS NOT NULL").collect()) == [(1, "d"), (2, "b"), (3, "e")]
    assert read_source(spark, at).where("ID IS NULL").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        write_sink(twice.withColumnRenamed("NAME", "OTHER"), at | {"mode": "upsert", "key_columns": "ID"})
    names = read_source(spark, {"type": "sql", "dsn": at["dsn"], "query": "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'"})
    assert [r[0] for r in names.collect()] == ["T"]


def test_rows_reach_sqlite_without_the_driver(spark, tmp_path, monkeypatch):
    rows = spark.range(1000, numPartitions=6).where("id NOT BETWEEN 400 AND 600")
    odd = rows.selectExpr("id", "IF(id % 7 = 0, NULL, id / 4) AS half", "CAST(id AS DECIMAL(9,2)) AS d", "DATE'2020-01-01' AS day", "TIMESTAMP_NTZ'2020-01-01 01:02:03' AS at", "named_struct('a', id) AS s", "CAST('x' AS BINARY) AS b", "'é\n' AS t", "id > 5 AS yes")
    db = {"type": "sqlite", "database": str(tmp_path / "y.db"), "table": "t"}
    monkeypatch.setattr(databases, "staging_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("rows were sent to the driver"))
    write_sink(odd, db | {"create_table": True})
    with sqlite3.connect(db["database"]) as link:
        found = link.execute("SELECT * FROM t ORDER BY rowid").fetchall()
    ids = [i for i in range(1000) if not 400 <= i <= 600]
    assert [r[0] for r in found] == ids  # in the order of the rows
    plain = [c for c in odd.columns if c != "s"]
    at = [odd.columns.index(c) for c in plain]
    assert [tuple(r[i] for i in at) for r in found] == [tuple(databases._stored(r)) for r in odd.select(*plain).collect()] and found[1][5] == '{"a":1}'
    assert [r[1] for r in found] == [None if i % 7 == 0 else i / 4 for i in ids]
    # of rows with one key the last counts, and a failure leaves all as it was
    up = {"type": "sqlite", "database": db["database"], "table": "u", "key_columns": "k"}
    write_sink(spark.range(100, numPartitions=5).selectExpr("id % 10 AS k", "id AS v"), up | {"create_table": True, "mode": "upsert"})
    bad = spark.range(50, numPartitions=3).selectExpr("id + 100 AS k", "IF(id = 49, raise_error('no'), id) AS v")
    twice = spark.range(50, numPartitions=3).selectExpr("id % 49 + 100 AS k", "id AS v")
    for wrong in (bad, twice):
        with pytest.raises(PublishError):
            write_sink(wrong, up | {"mode": "append"})
    assert not list((tmp_path / "shared" / "loads").iterdir())
    with sqlite3.connect(db["database"]) as link:
        assert sorted(link.execute("SELECT * FROM u").fetchall()) == [(k, 90 + k) for k in range(10)]


@pytest.mark.parametrize("name", ["sql_without_rowid", "sql_query", "sql_view", "sql_where"])
def test_queries_send_no_rows_to_the_driver(spark, monkeypatch, name):
    from pyspark.sql import DataFrame

    from tidemill.queries import queries

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows were sent to the driver"))
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *_: pytest.fail("rows were sent to the driver"))
    assert queries()[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("name", ["sql_query", "sql_view"])
def test_what_tasks_send_to_the_driver_does_not_grow(spark, name):
    from tidemill.queries import queries

    def sent(size):
        """Bytes of results of all tasks, and the rows of the query."""
        sc = spark.sparkContext
        none = sc._gateway.new_array(sc._jvm.double, 0)
        stages = lambda: {(s.stageId(), s.attemptId()): s.resultSize() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList()))}
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = stages()
        rows = queries()[name](spark, f"/root/testdata/{size}").count()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(n for k, n in stages().items() if k not in before), rows

    (small, some), (large, more) = sent("sf0.001"), sent("sf0.01")
    assert 0 < large < 1.5 * small, (small, large)  # orders are ten times as many
    assert 0 < some <= more


@pytest.mark.parametrize("partitions", [3, 21])
@pytest.mark.parametrize("more", ["", "CAST(id AS DECIMAL(9,2)) AS d"])
def test_sqlite_copies_parts_itself(spark, tmp_path, monkeypatch, partitions, more):
    class Link(sqlite3.Connection):
        def executemany(self, *_):
            pytest.fail("rows were loaded one by one in the driver's process")

    monkeypatch.setattr(databases, "staging_dir", lambda _: f"file://{tmp_path}/shared")
    plain = ["id", "CAST(id AS SMALLINT) AS s", "CAST(id / 7 AS FLOAT) AS f", "IF(id % 3 = 0, double('NaN'), id / 7) AS h", "DATE'2020-01-01' AS day", "TIMESTAMP_NTZ'2020-01-01 01:02:03.5' AS at", "IF(id % 7 = 0, NULL, 'é\n\0x') AS t", "id > 5 AS yes"]
    rows = spark.range(500, numPartitions=partitions).where("id NOT BETWEEN 100 AND 200").selectExpr(*plain, *([more] if more else []))
    db = {"type": "sqlite", "database": str(tmp_path / "z.db")}
    up = spark.range(500, numPartitions=partitions).selectExpr("id % 10 AS k", "id AS v")
    connect = sqlite3.connect
    with connect(db["database"]) as link:
        link.execute(f"CREATE TABLE t ({', '.join(rows.columns)})")  # without types, so values stay as they are
    with monkeypatch.context() as m:
        m.setattr(sqlite3, "connect", lambda *a, **k: connect(*a, factory=Link, **k))
        write_sink(rows, db | {"table": "t"})
        write_sink(up, db | {"table": "u", "create_table": True, "mode": "upsert", "key_columns": "k"})
        with pytest.raises(PublishError):
            write_sink(up, db | {"table": "u", "mode": "append"})
        with pytest.raises(PublishError):
            write_sink(up, db | {"table": "missing"})
    with sqlite3.connect(db["database"]) as link:
        nan = [tuple(None if v != v else v for v in databases._stored(r)) for r in rows.collect()]
        assert link.execute("SELECT * FROM t ORDER BY rowid").fetchall() == nan
        assert sorted(link.execute("SELECT * FROM u").fetchall()) == [(k, 490 + k) for k in range(10)]
    assert not list((tmp_path / "shared" / "loads").iterdir())


@pytest.mark.parametrize("partitions", [3, 21])
@pytest.mark.parametrize("more", ["", "CAST(id AS DECIMAL(9,2)) AS d"])
def test_what_a_load_sends_to_the_driver_does_not_grow(spark, tmp_path, monkeypatch, partitions, more):
    monkeypatch.setattr(databases, "staging_dir", lambda _: f"file://{tmp_path}/shared")
    sc = spark.sparkContext
    context, none = sc._jsc.sc(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.resultSize() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)}

    def sent(rows):
        """Bytes of results of all tasks of a load into a table that is new or has to be kept up to date."""
        db, before = {"type": "sqlite", "database": str(tmp_path / f"{rows}.db"), "table": "t", "create_table": True}, stages()
        df = spark.range(rows, numPartitions=partitions).selectExpr("id", "id / 7 AS x", "sha2(string(id), 256) AS t", *([more] if more else []))
        write_sink(df, db)
        write_sink(df.select("id", "t"), db | {"table": "u", "mode": "upsert", "key_columns": "id"})
        with sqlite3.connect(db["database"]) as link:
            assert link.execute("SELECT (SELECT count(*) FROM t), (SELECT count(DISTINCT id) FROM u)").fetchone() == (rows, rows)
        return sum(n for k, n in stages().items() if k not in before)

    small, large = sent(1000), sent(20_000)
    assert 0 < large < 1.2 * small, (small, large)
