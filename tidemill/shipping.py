"""Getting this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to all executors, once for each application.

    Spark's own file distribution carries it, so executors need not share a folder with the
    driver or have it installed.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    fd, target = tempfile.mkstemp(prefix="tidemill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(application)
