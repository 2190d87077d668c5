"""Tables that cut a lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import ConfigurationError


def staging_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this machine when Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemill-")


_SCOPE = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """What this thread stages inside is deleted at the end, unless it's to be kept."""
    before = getattr(_SCOPE, "paths", None)
    _SCOPE.paths = held = []
    try:
        yield
    finally:
        _SCOPE.paths = before
        for path in held:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read back; ``keep`` it beyond a :func:`scratch`."""
    path = f"{staging_dir(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    held = getattr(_SCOPE, "paths", None)
    if held is not None and not keep:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
