"""SQL databases: SQLite from the standard library, others over JDBC."""

from __future__ import annotations

import itertools
import json
import os
import pickle
import re
import shutil
import sqlite3
import uuid
from contextlib import suppress

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError, PublishError
from tidemill.functions.columns import col, names_of, quoted
from tidemill.plans.staging import staging_dir
from tidemill.shipping import ship_package
from tidemill.sources.base import SINKS, SOURCES, mode_of

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)?")
#: Words that a filter fragment may not hold.
_BARRED = re.compile(
    r"(?i);|--|#|/\*|\*/|\b(?:xp_|sp_)|\b(?:union|intersect|except|drop|delete|truncate|insert|update|merge|alter|create|grant|revoke|exec|execute|call|copy"
    r"|attach|detach|pragma|into|pg_sleep|sleep|benchmark|waitfor|load_file|pg_read_file|pg_read_binary_file|pg_ls_dir|lo_import|lo_export|dblink|outfile|dumpfile)\b"
)


def identifier(name: str) -> str:
    """A checked and quoted name."""
    if not _NAME.fullmatch(name):
        raise ConfigurationError(f"{name!r} is no valid name")
    return ".".join(f'"{p}"' for p in name.split("."))


def statement(table: str | None = None, query: str | None = None, columns=None, where: str | None = None, order_by=None, limit: int | None = None) -> str:
    """The SELECT of a source."""
    if query:
        return query
    if not table:
        raise ConfigurationError("a SQL source needs a table or a query")
    if where and _BARRED.search(where):
        raise ConfigurationError(f"where {where!r} isn't a plain condition")
    out = f"SELECT {', '.join(map(identifier, names_of(columns))) or '*'} FROM {identifier(table)}"
    out += f" WHERE ({where})" if where else ""
    keys = [k.rsplit(" ", 1) if k.lower().endswith((" asc", " desc")) else [k, "asc"] for k in names_of(order_by)]
    out += " ORDER BY " + ", ".join(f"{identifier(k)} {d.upper()}" for k, d in keys) if keys else ""
    return out + (f" LIMIT {int(limit)}" if limit is not None else "")


def _sqlite_path(dsn: str | None, database: str | None) -> str | None:
    if dsn and dsn.startswith("sqlite:///"):
        return dsn[len("sqlite:///") :]
    return database if not dsn and database else None


def _jdbc(spark_io, dsn, host, port, database, user, password, driver):
    """JDBC options; the driver's jar must be on Spark's class path."""
    kinds = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql"}
    if not dsn:
        kind = kinds.get(driver or "postgresql", driver)
        dsn = f"jdbc:{kind}://{host}:{port or {'postgresql': 5432, 'mysql': 3306}.get(kind)}/{database}"
    dsn = dsn if dsn.startswith("jdbc:") else "jdbc:" + dsn
    out = spark_io.format("jdbc").option("url", dsn)
    for key, value in (("user", user), ("password", password)):
        out = out.option(key, value) if value else out
    return out


@SOURCES.register("sql", "sqlite", "postgres", "postgresql", "mysql")
def read_sql(spark: SparkSession, dsn: str | None = None, table: str | None = None, query: str | None = None, columns=None, where: str | None = None, order_by=None, limit: int | None = None, params: dict | None = None, database: str | None = None, host: str | None = None, port: int | None = None, user: str | None = None, password: str | None = None, driver: str | None = None, fetch_size: int = 10_000, partition_column: str | None = None, lower_bound=None, upper_bound=None, num_partitions: int = 8, snapshot: bool = False) -> DataFrame:
    """A table, view or query.

    Over JDBC Spark pushes filters and columns down, and ``partition_column`` with bounds reads
    in parallel.  A SQLite file, at a path that all executors share, is read by ranges of a key, one task each,
    with bounds at quantiles of a sample of its values: the row id, the primary key of a table
    without row ids, of a view the column with the most values, or ``partition_column``, which also splits a
    query.  All tasks read one state of the database: one that finds another state
    fails, unless ``snapshot`` has them read a copy that is made first.
    """
    path = _sqlite_path(dsn, database)
    if partition_column and limit is not None:
        raise ConfigurationError("a limit can't be read in parallel: leave out partition_column")
    if path is None:
        reader = _jdbc(spark.read, dsn, host, port, database, user, password, driver).option("fetchsize", fetch_size)
        if partition_column:
            reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower_bound).option("upperBound", upper_bound).option("numPartitions", num_partitions)
        text = statement(table, query, columns, where, order_by, limit)
        plain = table and not (query or where or order_by or limit is not None)
        df = reader.option("dbtable", table if plain else f"({text}) source_rows").load()
        return df.select(*(col(c) for c in names_of(columns))) if columns and plain else df
    if snapshot:
        path = _copied(spark, path)
    select = statement(table, query, columns, where, order_by, limit)
    state = _state(path)
    with sqlite3.connect(path) as link:
        names = [d[0] for d in link.execute(f"SELECT * FROM ({select}) LIMIT 0", params or {}).description]
        kinds = _kinds(link, select, params or {}, names)
        tasks = [(select, {})]
        if not order_by and limit is None and (partition_column or table and not query):
            tasks = _by_ranges(link, table, query, where, select, params or {}, partition_column, num_partitions)
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    bound = dict(params or {})

    def fetch(batches):
        import pandas as pd

        for pdf in batches:
            for text, more in zip(pdf["statement"], pdf["bounds"]):
                with sqlite3.connect(path) as link:
                    link.execute("BEGIN")
                    cursor = link.execute(text, bound | pickle.loads(more))
                    while rows := cursor.fetchmany(fetch_size):
                        yield pd.DataFrame([[_value(v, k) for v, k in zip(r, kinds)] for r in rows], columns=names, dtype=object)
                    if _state(path) != state:
                        raise PublishError(f"{path} changed while it was read; read it with snapshot=True")

    rows = [(text, pickle.dumps(more)) for text, more in tasks]
    return spark.createDataFrame(rows, "statement string, bounds binary").repartition(len(rows)).mapInPandas(fetch, schema)


def _state(path: str) -> tuple:
    """What changes with each transaction: the header's change counter, and the size and first bytes of a write-ahead log."""
    def start(name: str, size: int) -> bytes:
        try:
            with open(name, "rb") as f:
                return f.read(size)
        except FileNotFoundError:
            return b""

    log = f"{path}-wal"
    return start(path, 100)[24:28], os.path.getsize(log) if os.path.exists(log) else 0, start(log, 32)


def _copied(spark: SparkSession, path: str) -> str:
    """A copy of the database as it is now, in the shared folder."""
    folder = staging_dir(spark).removeprefix("file://") + "/databases"
    os.makedirs(folder, exist_ok=True)
    copy = f"{folder}/{uuid.uuid4().hex}.db"
    with sqlite3.connect(path) as link:
        link.execute("VACUUM INTO ?", (copy,))
    return copy


#: Keys of a sample for each range.
_SAMPLED = 200


def _by_ranges(link, table: str | None, query: str | None, where: str | None, select: str, params: dict, column: str | None, parts: int) -> list[tuple[str, dict]]:
    """(statement, its further parameters) that split the rows evenly by a key; the first range has the nulls."""
    source = f"({query})" if query else identifier(table)
    key = identifier(column) if column else _key_of(link, table)
    if key is None or parts <= 1:
        return [(select, {})]
    rest = f" WHERE ({where})" if where else ""
    total = link.execute(f"SELECT count(*) FROM {source}{rest}", params).fetchone()[0]
    every = max(1, total // (_SAMPLED * parts))
    joined = f"{rest} AND" if where else " WHERE"
    # an even share of the rows in the order of the scan, so that also a sorted table is covered
    sample = [r[0] for r in link.execute(f"SELECT {key} FROM {source}{joined} {key} IS NOT NULL AND abs(random()) % {every} = 0 ORDER BY {key}", params)]
    bounds = list(dict.fromkeys(sample[i * len(sample) // parts] for i in range(1, parts))) if sample else []
    if query:
        select, joined = f"SELECT * FROM {source}", " WHERE"
    else:
        joined = " AND" if where else " WHERE"
    out = []
    for i in range(len(bounds) + 1):
        more = {"tm_low": bounds[i - 1]} if i else {}
        more |= {"tm_high": bounds[i]} if i < len(bounds) else {}
        parts_of = ([f"{key} >= :tm_low"] if i else []) + ([f"{key} < :tm_high"] if i < len(bounds) else [])
        inside = " AND ".join(parts_of) or "1"
        out.append((f"{select}{joined} ({inside}{'' if i else f' OR {key} IS NULL'})", more))
    return out


def _key_of(link, table: str) -> str | None:
    """The column that splits a table or view; None if nothing does."""
    columns = link.execute(f"PRAGMA table_info({identifier(table.rsplit('.', 1)[-1])})").fetchall()
    if not columns:
        return None
    kind = link.execute("SELECT type FROM sqlite_master WHERE lower(name) = lower(?)", (table.rsplit(".", 1)[-1],)).fetchone()
    if kind and kind[0] == "table":
        try:
            link.execute(f"SELECT rowid FROM {identifier(table)} LIMIT 0")
            return "rowid"
        except sqlite3.OperationalError:
            first = min((c for c in columns if c[5]), key=lambda c: c[5])
            return '"' + first[1].replace('"', '""') + '"'
    names = ['"' + c[1].replace('"', '""') + '"' for c in columns]
    asked = ", ".join(f"count(DISTINCT {n})" for n in names)
    found = link.execute(f"SELECT {asked} FROM (SELECT * FROM {identifier(table)} LIMIT 5000)").fetchone()
    most = max(range(len(names)), key=lambda i: found[i])
    return names[most] if found[most] > 1 else None


def _kinds(link, select: str, params: dict, names: list[str]) -> list[T.DataType]:
    """Types that hold every value of the result: long, double, or text where any value is text."""
    quoted_names = ['"' + n.replace('"', '""') + '"' for n in names]
    asked = ", ".join(f"max(typeof({n}) = '{kind}')" for n in quoted_names for kind in ("integer", "real", "text", "blob"))
    found = link.execute(f"SELECT {asked} FROM ({select})", params).fetchone()
    out = []
    for i in range(len(names)):
        whole, real, text, blob = found[4 * i : 4 * i + 4]
        out.append(T.StringType() if text or blob or not (whole or real) else T.DoubleType() if real else T.LongType())
    return out


def _value(v, kind):
    if v is None:
        return None
    return int(v) if isinstance(kind, T.LongType) else float(v) if isinstance(kind, T.DoubleType) else v if isinstance(v, str) else str(v)


def merge_statement(url: str, table: str, staging: str, names: list[str], keys: list[str]) -> str:
    """The statement that brings the rows of a staging table into a table, by its keys."""
    listed, rest = ", ".join(names), [n for n in names if n not in keys]
    if ":mysql:" in url or ":mariadb:" in url:
        action = ", ".join(f"{n} = VALUES({n})" for n in rest or keys)
        return f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {staging} ON DUPLICATE KEY UPDATE {action}"
    same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{n} = s.{n}' for n in rest)}" if rest else ""
    return f"MERGE INTO {table} t USING {staging} s ON {same}{update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{n}' for n in names)})"


def _merge_jdbc(df: DataFrame, table: str, names: list[str], keys: list[str], jdbc, chunk_size: int) -> None:
    """Executors load a staging table, then the database merges it; the staging table goes in any case.

    Of rows with the same key the last one counts, as it would if they came one after another.
    """
    for n in [*names, table]:
        identifier(n)  # checks the name; databases fold unquoted ones alike
    if not keys:
        raise ConfigurationError("upsert needs key_columns")
    keyed = " AND ".join(f"{quoted(k)} IS NOT NULL" for k in keys)
    last = df.where(keyed).withColumn("__n", F.monotonically_increasing_id()).groupBy(*(col(k) for k in keys)).agg(F.max_by(F.struct(*(col(n) for n in names)), "__n").alias("__last")).select("__last.*")
    df = last.unionByName(df.where(f"NOT ({keyed})").select(*(col(n) for n in names)))
    staging = f"{table}_{uuid.uuid4().hex[:12]}"
    url = jdbc(_Options()).found["url"]
    login = jdbc(_Options()).found
    jvm = df.sparkSession.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if login.get(k):
            properties.setProperty(k, login[k])
    try:
        jdbc(df.write).option("dbtable", staging).option("batchsize", chunk_size).mode("errorifexists").save()
        _execute(jvm, url, properties, merge_statement(url, table, staging, names, keys))
    except Exception as e:
        raise PublishError(f"{table}: {e}") from e
    finally:
        with suppress(Exception):  # it may not be there
            _execute(jvm, url, properties, f"DROP TABLE {staging}")


def _execute(jvm, url: str, properties, text: str) -> None:
    link = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        link.createStatement().execute(text)
    finally:
        link.close()


class _Options:
    """Collects reader options."""

    def __init__(self):
        self.found: dict[str, str] = {}

    def format(self, _):
        return self

    def option(self, key, value):
        self.found[key] = value
        return self


#: SQL types of created tables.
_DDL = {T.LongType: "BIGINT", T.IntegerType: "BIGINT", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP", T.DateType: "DATE"}


def _stored(row) -> list:
    """The values of a row as SQLite holds them."""
    return [v if isinstance(v, (int, float, str, type(None))) else v.isoformat() if hasattr(v, "isoformat") else json.dumps(v, default=str) for v in row]


def _parts_folder(spark: SparkSession) -> str | None:
    """A new folder that tasks and driver open by the same path, if there is one."""
    try:
        top = re.sub("^file:(//)?", "", staging_dir(spark))
    except ConfigurationError:
        return None
    return f"{top}/loads/{uuid.uuid4().hex}" if top.startswith("/") else None


#: Types whose values are the same Python objects in Arrow batches and in rows.
_ALIKE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
#: The table of a part; no valid name of a target is like it.
_PART = '"a part"'
#: SQLite attaches ten files at most.
_ATTACHED = 8


def _new_part(folder: str, width: int):
    """A new part file and its connection; an attempt of a task has its own."""
    path = f"{folder}/{uuid.uuid4().hex}.db"
    link = sqlite3.connect(path, isolation_level=None)
    link.execute("PRAGMA journal_mode = OFF")
    link.execute("PRAGMA synchronous = OFF")
    link.execute(f"CREATE TABLE {_PART} ({', '.join(f'c{i}' for i in range(width))})")
    return path, link


def _store_parts(df: DataFrame, folder: str) -> list[str]:
    """At most ``_ATTACHED`` files with the rows of all partitions, in order."""
    os.makedirs(folder)
    ship_package(df.sparkSession)
    width = len(df.columns)

    def store(number, rows):
        rows = map(_stored, rows)
        if (first := next(rows, None)) is None:
            return
        path, link = _new_part(folder, width)
        link.execute("BEGIN")
        link.executemany(f"INSERT INTO {_PART} VALUES ({', '.join('?' * width)})", itertools.chain([first], rows))
        link.execute("COMMIT")
        link.close()
        yield number, path

    def store_batches(batches):
        import pyarrow as pa

        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        for number, path in store(TaskContext.get().partitionId(), rows):
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "path": [path]})

    def join(paths):
        path, link = _new_part(folder, width)
        for one in paths:
            link.execute("ATTACH ? AS next", (one,))
            link.execute(f"INSERT INTO main.{_PART} SELECT * FROM next.{_PART} ORDER BY rowid")
            link.execute("DETACH next")
        link.close()
        return path

    if all(isinstance(f.dataType, _ALIKE) for f in df.schema.fields):
        valid = df.select(*(F.make_valid_utf8(col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields))
        stored = valid.mapInArrow(store_batches, "number int, path string").collect()
    else:
        stored = df.rdd.mapPartitionsWithIndex(store).collect()
    paths = [path for _, path in sorted(stored)]
    if len(paths) <= _ATTACHED:
        return paths
    each = -(-len(paths) // _ATTACHED)
    runs = [paths[i : i + each] for i in range(0, len(paths), each)]
    joined = df.sparkSession.sparkContext.parallelize(runs, len(runs)).map(join).collect()
    for path in paths:
        os.remove(path)
    return joined


@SINKS.register("sql", "sqlite", "postgres", "postgresql", "mysql")
def write_sql(df: DataFrame, table: str, dsn: str | None = None, database: str | None = None, mode: str | None = None, columns=None, key_columns=None, create_table: bool = False, chunk_size: int = 1000, host: str | None = None, port: int | None = None, user: str | None = None, password: str | None = None, driver: str | None = None) -> None:
    """Append, overwrite, upsert or fill a table.

    A SQLite load is one transaction, and a failure leaves the table as it was: tasks store their
    rows as SQLite files in the shared folder, and the database, which has one writer, copies them
    itself in the order of the partitions.  Rows are sent to the driver only if that folder is no path of a file system
    or there is none.  Over JDBC, Spark appends or truncates and fills; an
    upsert loads a staging table that the database merges.
    """
    mode = mode_of(mode, ("append", "overwrite", "upsert", "error_if_exists"))
    names, keys = names_of(columns) or df.columns, names_of(key_columns)
    flat = df.select(*(F.to_json(col(c)).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else col(c) for c in names))
    path = _sqlite_path(dsn, database)
    if path is None:
        if mode == "upsert":
            _merge_jdbc(flat, table, names, keys, lambda io: _jdbc(io, dsn, host, port, database, user, password, driver), chunk_size)
            return
        writer = _jdbc(flat.write, dsn, host, port, database, user, password, driver).option("dbtable", table).option("truncate", True).option("batchsize", chunk_size)
        writer.mode({"append": "append", "overwrite": "overwrite", "error_if_exists": "errorifexists"}[mode]).save()
        return
    if mode == "upsert" and not keys:
        raise ConfigurationError("upsert needs key_columns")
    target, listed = identifier(table), ", ".join(map(identifier, names))
    into, clash = f"INSERT INTO {target} ({listed})", ""
    if mode == "upsert":
        rest = [c for c in names if c not in keys]
        action = "UPDATE SET " + ", ".join(f"{identifier(c)} = excluded.{identifier(c)}" for c in rest) if rest else "NOTHING"
        clash = f" ON CONFLICT ({', '.join(map(identifier, keys))}) DO {action}"
    folder = _parts_folder(flat.sparkSession)
    link = sqlite3.connect(path, isolation_level=None)
    try:
        parts = _store_parts(flat, folder) if folder else []
        for i, part in enumerate(parts):
            link.execute(f'ATTACH ? AS "part {i}"', (part,))
        link.execute("BEGIN IMMEDIATE")
        if create_table:
            typed = ", ".join(f"{identifier(f.name)} {_DDL.get(type(f.dataType), 'TEXT')}" for f in flat.schema.fields)
            unique = f", PRIMARY KEY ({', '.join(map(identifier, keys))})" if keys else ""
            link.execute(f"CREATE TABLE IF NOT EXISTS {target} ({typed}{unique})")
        if mode == "error_if_exists" and link.execute(f"SELECT 1 FROM {target} LIMIT 1").fetchone():
            raise PublishError(f"{table} has rows already")
        if mode == "overwrite":
            link.execute(f"DELETE FROM {target}")
        for i in range(len(parts)):
            link.execute(f'{into} SELECT * FROM "part {i}".{_PART} WHERE true ORDER BY rowid{clash}')
        if not folder:
            link.executemany(f"{into} VALUES ({', '.join('?' * len(names))}){clash}", map(_stored, flat.toLocalIterator()))
        link.execute("COMMIT")
    except Exception as e:
        if link.in_transaction:
            link.execute("ROLLBACK")
        raise e if isinstance(e, (ConfigurationError, PublishError)) else PublishError(f"{table}: {e}") from e
    finally:
        link.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
