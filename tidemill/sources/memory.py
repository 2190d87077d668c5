"""Inline rows, named tables, generated rows, and sinks that keep or count rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import names_of
from tidemill.sources.base import SINKS, SOURCES, mode_of

#: Inline rows at most.
MOST_INLINE = 5_000_000


def _view(name: str) -> str:
    return "tidemill_memory_" + "".join(c if c.isalnum() else "_" for c in name)


@SOURCES.register("memory", "inline")
def read_memory(spark: SparkSession, records=None, dataset: str | None = None, schema: str | None = None) -> DataFrame:
    """Rows given in place, or what a memory sink of that name holds; an unknown name has no rows."""
    if dataset is not None:
        if spark.catalog.tableExists(_view(dataset)):
            return spark.table(_view(dataset))
        return spark.createDataFrame([], schema or T.StructType([]))
    records = records or []
    if len(records) > MOST_INLINE:
        raise ConfigurationError(f"at most {MOST_INLINE} inline rows")
    if schema:
        return spark.createDataFrame([tuple(r.get(n) for n in T.StructType.fromDDL(schema).fieldNames()) for r in records], schema)
    names = list(dict.fromkeys(k for r in records for k in r))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    kinds = [_kind([r.get(n) for r in records]) for n in names]
    rows = [tuple(_fit(r.get(n), k) for n, k in zip(names, kinds)) for r in records]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k or T.StringType()) for n, k in zip(names, kinds)]))


def _kind(values: list):
    """The type that holds all values; text if they differ, None to let Spark infer nested ones."""
    found = {type(v) for v in values if v is not None}
    if found <= {int}:
        return T.LongType() if found else T.StringType()
    if found <= {int, float}:
        return T.DoubleType()
    if found == {bool}:
        return T.BooleanType()
    if found == {dict}:
        return T.MapType(T.StringType(), _kind([x for v in values if v for x in v.values()]))
    if found == {list}:
        return T.ArrayType(_kind([x for v in values if v for x in v]))
    return T.StringType()


def _fit(v, kind):
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    return str(v) if isinstance(kind, T.StringType) and not isinstance(v, str) else v


@SOURCES.register("generator", "synthetic")
def read_generator(spark: SparkSession, rows: int = 1000, columns=("id", "name", "amount", "created_at"), rate: float | None = None, seed: int = 0) -> DataFrame:
    """Made-up rows whose columns' names say what they hold; with ``rate`` a stream of so many rows a second."""
    if rate:
        df = spark.readStream.format("rate").option("rowsPerSecond", max(1, int(rate))).load().select(F.col("value").alias("__n"))
    else:
        df = spark.range(rows).select(F.col("id").alias("__n"))
    u = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("__n")), F.lit(1_000_003)) / 1_000_003
    pick = lambda name, *v: F.element_at(F.array(*(F.lit(x) for x in v)), (F.floor(u(name) * len(v)) + 1).cast("int"))

    def made(name: str):
        low = name.lower()
        if low == "id" or low.endswith("_id"):
            return F.col("__n") + 1
        if "email" in low:
            return F.concat(F.lit("user"), F.col("__n"), F.lit("@example.com"))
        if "name" in low:
            return pick(name, "Ada", "Ben", "Cleo", "Dan", "Eve", "Finn")
        if any(x in low for x in ("amount", "price", "total", "value")):
            return F.round(u(name) * 1000, 2)
        if any(x in low for x in ("quantity", "count", "age")):
            return F.floor(u(name) * 100).cast("long")
        if any(x in low for x in ("_at", "date", "time")):
            return F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(u(name) * 31_536_000).cast("long")).cast("timestamp_ntz")
        if low.startswith("is_") or "flag" in low:
            return u(name) < 0.5
        return pick(name, "alpha", "beta", "gamma", "delta")

    return df.select(*(made(c).alias(c) for c in names_of(columns)))


@SINKS.register("memory")
def write_memory(df: DataFrame, dataset: str = "default", mode: str | None = None) -> None:
    """Keep rows under a name for this session, staged so that they are computed once."""
    from tidemill.plans.staging import staged

    mode = mode_of(mode, ("append", "overwrite"))
    spark = df.sparkSession
    held = staged(df, keep=True)
    if mode == "append" and spark.catalog.tableExists(_view(dataset)):
        held = spark.table(_view(dataset)).unionByName(held, allowMissingColumns=True)
    held.createOrReplaceTempView(_view(dataset))


@SINKS.register("null", "devnull")
def write_null(df: DataFrame, mode: str | None = None) -> int:
    """Compute everything, keep nothing, and give the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


@SOURCES.register("spark")
def read_format(spark: SparkSession, format: str, path: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """Any data source that Spark has, built in, from a jar or registered in Python."""
    reader = spark.read.format(format).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load(path) if path else reader.load()


@SINKS.register("spark")
def write_format(df: DataFrame, format: str, path: str | None = None, mode: str | None = None, **options) -> None:
    """Any data source that Spark can write to."""
    mode = mode_of(mode, ("append", "overwrite", "error_if_exists"))
    writer = df.write.format(format).options(**options).mode("error" if mode == "error_if_exists" else mode)
    writer.save(path) if path else writer.save()
