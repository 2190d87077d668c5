"""Registries of sources and sinks, and staged publishing of files."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import ConfigurationError, PublishError
from tidemill.registry import Registry

SOURCES = Registry("source")
SINKS = Registry("sink")


def read_source(spark: SparkSession, spec: dict) -> DataFrame:
    """The DataFrame of a source, given as its type and options."""
    options = {k: v for k, v in spec.items() if k not in ("type", "name", "batch_size", "retry", "incremental")}
    if isinstance(options.get("path"), str) and SOURCES.key(spec.get("type", "")) in STAGED_KINDS:
        from tidemill.sources.commits import recover

        # a target that a crash has left without data; what is there is read as it is
        if not any(c in options["path"] for c in "*?[{") and not Folder(spark, options["path"]).exists():
            recover(spark, options["path"])
    return _call(SOURCES, spec, spark, options)


def write_sink(df: DataFrame, spec: dict) -> int | None:
    """Write to a sink; gives the number of rows if the sink counts them."""
    options = {k: v for k, v in spec.items() if k not in ("type", "name", "batch_size", "retry")}
    return _call(SINKS, spec, df, options)


def _call(registry: Registry, spec: dict, first, options: dict):
    build = registry.get(spec.get("type", ""))
    try:
        return build(first, **options)
    except TypeError as e:
        raise ConfigurationError(f"{registry.what} {spec.get('type')!r}: {e}") from e


def mode_of(mode: str | None, allowed: tuple[str, ...]) -> str:
    """The write mode, by default the first of those allowed."""
    if mode is None:
        return allowed[0]
    if mode not in allowed:
        raise ConfigurationError(f"mode is one of {', '.join(allowed)}")
    return mode


class Folder:
    """A target folder on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.context = spark.sparkContext
        self.jvm = self.context._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def filled(self) -> bool:
        return self.exists() and any(not s.getPath().getName().startswith(("_", ".")) for s in self.fs.listStatus(self.path))

    def beside(self, name: str) -> Folder:
        out = object.__new__(Folder)
        out.context, out.jvm, out.fs = self.context, self.jvm, self.fs
        out.path = self.jvm.org.apache.hadoop.fs.Path(self.path.getParent(), name)
        return out

    def sibling(self) -> Folder:
        return self.beside(f".{self.path.getName()}.{uuid.uuid4().hex}.staging")

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def rename(self, to: Folder) -> None:
        if not self.fs.rename(self.path, to.path):
            raise PublishError(f"{self.path} couldn't become {to.path}")

    def replace(self, file: Folder) -> None:
        """This file takes the other's place in one step, so that a crash leaves the old one or the new one."""
        context = self.context
        kinds = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        how = context._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(file.path).toUri(), context._jsc.hadoopConfiguration())
        files.rename(self.fs.makeQualified(self.path), file.fs.makeQualified(file.path), how)

    def move_files(self, to: Folder) -> list[str]:
        """Move the data files into another folder; gives their names there."""
        moved = []
        for s in self.fs.listStatus(self.path):
            name = s.getPath().getName()
            if not name.startswith(("_", ".")):
                if not self.fs.rename(s.getPath(), self.jvm.org.apache.hadoop.fs.Path(to.path, name)):
                    raise PublishError(f"{s.getPath()} couldn't move to {to.path}")
                moved.append(name)
        return moved


_LATER = threading.local()


def later(work) -> None:
    """Do ``work`` once the task that reads has published its rows, or now outside a pipeline."""
    held = getattr(_LATER, "after", None)
    work() if held is None else held.append(work)


@contextmanager
def after_publishing(dry_run: bool = False):
    """What :func:`later` is given inside is done at the end, unless that is an error or a dry run."""
    _LATER.after = held = []
    try:
        yield
    finally:
        _LATER.after = None
    for work in held if not dry_run else ():
        work()


#: Sinks whose data is staged before it is published.
STAGED_KINDS = ("csv", "json", "jsonl", "ndjson", "xml", "parquet")


def publish_all(outputs: list[tuple[DataFrame, dict]]) -> None:
    """Write several outputs that belong together.

    Those that can be staged are staged first.  Then the others are written, in the order given, and at last
    all that is staged is published at once (:mod:`tidemill.sources.commits`).  So a failure anywhere publishes
    nothing that is staged; of outputs that can't be staged, those before the failed one stay.
    """
    from tidemill.sources.commits import Publication

    direct = [(df, spec) for df, spec in outputs if SINKS.key(spec.get("type", "")) not in STAGED_KINDS]
    publication = Publication(outputs[0][0].sparkSession) if outputs else None
    _LATER.publication = publication
    try:
        for df, spec in outputs:
            if SINKS.key(spec.get("type", "")) in STAGED_KINDS:
                write_sink(df, spec)
        _LATER.publication = None
        for df, spec in direct:
            write_sink(df, spec)
    except Exception:
        if publication is not None:
            publication.abandon()
        raise
    finally:
        _LATER.publication = None
    if publication is not None:
        publication.commit()


def publish(df: DataFrame, path: str, mode: str, write) -> None:
    """Write to a staging folder beside ``path``, then swap or append; a failed write leaves the target as it was."""
    from tidemill.sources.commits import Publication, recover

    recover(df.sparkSession, path)
    target = Folder(df.sparkSession, path)
    if mode == "error_if_exists" and target.filled():
        raise PublishError(f"{path} exists already")
    staging = target.sibling()
    try:
        write(df.write, staging.path.toString())
    except Exception:
        staging.delete()
        raise
    held = getattr(_LATER, "publication", None)
    publication = held if held is not None else Publication(df.sparkSession)
    publication.add(staging, target, mode)
    if held is None:
        publication.commit()
