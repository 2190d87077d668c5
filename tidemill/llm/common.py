"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(column):
    """The text with A-Z lower-cased and nothing else changed; null becomes the empty text."""
    from pyspark.sql import functions as F

    return F.translate(F.coalesce(column, F.lit("")), _ASCII_UPPER, _ASCII_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one when Spark itself is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(spark, "_tidemill_dir", None):
        spark._tidemill_dir = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return spark._tidemill_dir


def own_dir(spark: SparkSession) -> str:
    """This application's folder below :func:`shared_dir`; others that share it have their own."""
    return f"{shared_dir(spark)}/tidemill/{spark.sparkContext.applicationId}"


#: Bytes of one batch to Python at most, and one row at least; texts can be long.
BATCH_BYTES = "4m"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark then deletes a query's shuffle files when the query ends, not when the driver collects its garbage.
_SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def staging(spark: SparkSession):
    """Session settings for the time of one staged job: small batches to Python, and no shuffle files left."""
    wanted = {_BATCH_BYTES: BATCH_BYTES, _SHORT_SHUFFLES: "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bound_batches(spark: SparkSession) -> None:
    """Small batches to Python from now on, for results that are computed later; a session's own setting stays."""
    if spark.conf.get(_BATCH_BYTES) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage once, is computed once, and outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with staging(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemill_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_tidemill_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def contiguous_groups(batches, keys: list[str]):
    """Regroup Arrow batches of a key-sorted partition into whole groups.

    Yields pandas frames that hold one or more complete groups of ``keys``; only the last
    group of a batch is carried over, so memory is one batch and one group.
    """
    import pandas as pd

    held = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = pdf[keys].iloc[-1]
        same = (pdf[keys] == last).all(axis=1).to_numpy()
        start = len(same) - int(same[::-1].argmin() if not same.all() else len(same))
        if start == 0:
            if held and not (held[-1][keys].iloc[-1] == last).all():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf)
            continue
        yield pd.concat([*held, pdf.iloc[:start]], ignore_index=True)
        held = [pdf.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def text_slices(batch, text_col: str, most_bytes: int = 1 << 22):
    """Slices of an Arrow batch with about ``most_bytes`` of text each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text_col))).fill_null(0)
    ends = np.append(0, np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most_bytes, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


_ARROW_TYPES = {"int": "int32", "long": "int64", "double": "float64", "string": "string", "binary": "binary", "boolean": "bool"}


def in_slices(work, schema: str, text_col: str, most_bytes: int = 1 << 22):
    """A function for ``mapInArrow`` that feeds ``work`` pandas frames of bounded text.

    Arrow batches have a fixed number of rows, so long texts make them large; ``work``
    iterates over frames of about ``most_bytes`` of text and yields frames with the columns of
    ``schema`` (names and types, comma-separated).
    """
    names = [tuple(c.split()) for c in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        out = pa.schema([(n, pa.type_for_alias(_ARROW_TYPES[t])) for n, t in names])

        def frames():
            for batch in batches:
                for part in text_slices(batch, text_col, most_bytes):
                    yield part.to_pandas()

        for pdf in work(frames()):
            yield pa.RecordBatch.from_pandas(pdf, out, preserve_index=False)

    return run


#: Spark's own limit for the buckets of a table.
MOST_BUCKETS = 100_000


def bucketed(docs: DataFrame, buckets: int, column: str) -> DataFrame:
    """``docs`` as a table bucketed by ``column``, so that joins on it don't shuffle the texts.

    One shuffle by the same key gives each bucket one file.  There are ``buckets`` buckets, or
    as many as shuffle partitions if those are more: Spark shuffles a bucketed side after all
    if the other side would have more partitions.  The table stays until :func:`drop_tables`.
    """
    spark = docs.sparkSession
    buckets = min(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_BUCKETS)
    name = f"{_tables(spark)}{uuid.uuid4().hex}"
    writer = docs.repartition(buckets, column).write.bucketBy(buckets, column)
    with staging(spark):
        writer.option("path", f"{own_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _tables(spark: SparkSession) -> str:
    """How the names of this application's bucketed tables begin; a catalog may be shared."""
    return "tidemill_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId.lower()) + "_"


def drop_tables(spark: SparkSession) -> None:
    """Delete what the operators have staged in this application, once their results are written: its bucketed tables and its folder."""
    for t in spark.catalog.listTables():
        if t.name.startswith(_tables(spark)) and not t.isTemporary:
            spark.sql(f"DROP TABLE `{t.name}`")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def later_copies(table: DataFrame, keys: list[str]) -> DataFrame:
    """Ids (_id) of rows whose ``keys``, digests of a text, an earlier id has too; large groups combine before they shuffle."""
    from pyspark.sql import functions as F

    prints = table.where("_id is not null").select("_id", *keys)
    groups = prints.groupBy(*keys).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    groups = materialize(groups, "copied-texts")
    copies = materialize(prints.join(groups, keys).where("_id > _first").select("_id").distinct(), "later-copies")
    discard(groups)
    return copies


def text_bytes(column):
    """An expression for the total of UTF-8 bytes, for sizing partitions."""
    from pyspark.sql import functions as F

    return F.sum(F.octet_length(column).cast("long"))


def pack(*arrays) -> bytes:
    """Numpy arrays as one compressed string."""
    import zstandard

    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.num, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


_KINDS = {np.dtype(k).num: np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.int64, np.uint64)}


def unpack(raw: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k, size in head.reshape(-1, 2):
        kind = _KINDS[int(k)]
        out.append(np.frombuffer(data, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def by_key(batches, key: str):
    """(key, payloads) of a partition sorted by ``key``."""
    at, held = None, []
    for pdf in batches:
        for k, p in zip(pdf[key], pdf["payload"]):
            if held and k != at:
                yield at, held
                held = []
            at = k
            held.append(p)
    if held:
        yield at, held


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
