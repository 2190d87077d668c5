"""Files on FTP and SFTP servers.

Large CSV and JSON-lines files are read in ranges by tasks, and with ``parts`` tasks send part
files (:mod:`tidemill.sources.remote_parts`).  Other files are fetched to, or sent from, the
shared staging folder, a block at a time.
"""

from __future__ import annotations

import ftplib
import io
import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import ConfigurationError
from tidemill.plans.staging import staged, staging_dir
from tidemill.functions.columns import col
from tidemill.shipping import ship_package
from tidemill.sources.base import SINKS, SOURCES, Folder, later, read_source, write_sink
from tidemill.sources.files import csv_cells, read_csv_ranges
from tidemill.sources.ranges import range_size
from tidemill.sources.remote_parts import RemoteLines, RemoteParts, connect

#: The format that a suffix stands for.
_SUFFIXES = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "ndjson", "xml": "xml", "parquet": "parquet", "xlsx": "excel"}
_BLOCK = 1 << 20


def _format(path: str, given: str | None) -> str:
    found = given or _SUFFIXES.get(path.rsplit(".", 1)[-1].lower())
    if not found:
        raise ConfigurationError(f"can't tell the format of {path}")
    return found


def _ftp(host: str, port: int, user: str, password: str, tls: bool, passive: bool):
    link = (ftplib.FTP_TLS if tls else ftplib.FTP)()
    link.connect(host, port, timeout=30)
    link.login(user, password)
    if tls:
        link.prot_p()
    link.set_pasv(passive)
    return link


def _into(spark: SparkSession, name: str):
    """A new file in the staging folder and a stream into it; only a block at a time is held."""
    folder = Folder(spark, f"{staging_dir(spark)}/remote/{name}").sibling()
    target = folder.jvm.org.apache.hadoop.fs.Path(folder.path, name)
    return target.toString(), folder.fs.create(target, True)


def _in_ranges(spark: SparkSession, login: dict, path: str, format: str, range_bytes: int | None, options: dict) -> DataFrame | None:
    """The file read by tasks, if it's of a format that has ranges and larger than one."""
    kind = SOURCES.key(format)
    if kind not in ("csv", "jsonl", "ndjson") or kind != "csv" and options.get("root"):
        return None
    link = None
    try:
        link = connect(login)
        size = link.size(path)
    except (OSError, AttributeError, *ftplib.all_errors):  # a server that doesn't tell
        return None
    finally:
        if link is not None:
            link.close()
    range_bytes = range_bytes or range_size(spark)
    if not size or size <= range_bytes:
        return None
    if kind == "csv":
        return read_csv_ranges(spark, path, size, login, range_bytes, **options)
    ship_package(spark)
    spark.dataSource.register(RemoteLines)
    how = {"path": path, "size": size, "range": range_bytes, "encoding": options.get("encoding", "utf-8")}
    lines = spark.read.format(RemoteLines.name()).option("how", json.dumps(how)).option("secret_login", json.dumps(login)).load()
    copy = f"{staging_dir(spark)}/remote/{uuid.uuid4().hex}"
    lines.write.text(copy)  # JSON is read twice, for its schema and its rows
    return read_source(spark, {"type": format, "path": copy, "format": "lines"} | {k: v for k, v in options.items() if k != "encoding"})


def _send_parts(df: DataFrame, login: dict, path: str, format: str, options: dict) -> None:
    """Each task sends its rows as one part file; the parts appear together when all are there."""
    kind = SOURCES.key(format)
    if kind == "csv":
        write = {"delimiter": ",", "write_header": True} | options
        cells = csv_cells(df, write.get("columns"), write.get("escape_formulas", True), write.get("null_value", ""))
        how = {"sep": write["delimiter"], "escape": '"', "emptyValue": ""}
        rows = cells.select(F.to_csv(F.struct(*(col(c) for c in cells.columns)), how).alias("value"))
        head = df.sparkSession.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{i}") for i, c in enumerate(cells.columns))), how)).first()[0] + "\n" if write["write_header"] else ""
    elif kind in ("jsonl", "ndjson"):
        rows, head = df.select(F.to_json(F.struct(*(col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("value")), ""
    else:
        raise ConfigurationError("parts are of csv or jsonl")
    ship_package(df.sparkSession)
    df.sparkSession.dataSource.register(RemoteParts)
    how = {"path": path, "head": head, "run": uuid.uuid4().hex[:12]}
    rows.write.format(RemoteParts.name()).option("how", json.dumps(how)).option("secret_login", json.dumps(login)).mode("append").save()


@SOURCES.register("ftp", "ftps")
def read_ftp(spark: SparkSession, host: str, remote_path: str, port: int = 21, user: str = "anonymous", password: str = "", format: str | None = None, tls: bool = True, passive: bool = True, range_bytes: int | None = None, **options) -> DataFrame:
    """A remote file through the source of its format."""
    login = {"kind": "ftp", "given": [host, port, user, password, tls, passive]}
    found = _in_ranges(spark, login, remote_path, _format(remote_path, format), range_bytes, options)
    if found is not None:
        return found
    path, stream = _into(spark, posixpath.basename(remote_path))
    link = _ftp(host, port, user, password, tls, passive)
    try:
        link.retrbinary(f"RETR {remote_path}", lambda block: stream.write(bytearray(block)), _BLOCK)
    finally:
        stream.close()
        link.close()
    return read_source(spark, {"type": _format(remote_path, format), "path": path, **options})


def _single(df: DataFrame, format: str, options: dict) -> tuple[Folder, list[str]]:
    """The part files of a local write, to be sent one after another."""
    spark = df.sparkSession
    folder = Folder(spark, f"{staging_dir(spark)}/remote/out").sibling()
    write_sink(df.coalesce(1), {"type": format, "path": folder.path.toString(), "mode": "overwrite", **options})
    if not folder.fs.getFileStatus(folder.path).isDirectory():
        return folder, [folder.path.toString()]
    return folder, [s.getPath().toString() for s in folder.fs.listStatus(folder.path) if not s.getPath().getName().startswith(("_", "."))]


class _Reader(io.RawIOBase):
    """A Hadoop input stream as a Python one."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def read(self, size=-1):
        return bytes(self.stream.readNBytes(size if size and size > 0 else _BLOCK))


@SINKS.register("ftp", "ftps")
def write_ftp(df: DataFrame, host: str, remote_path: str, port: int = 21, user: str = "anonymous", password: str = "", format: str | None = None, tls: bool = True, passive: bool = True, mode: str | None = None, parts: bool = False, **options) -> None:
    """One remote file, sent under another name and then renamed; or ``parts`` that tasks send, named after it."""
    if parts:
        _send_parts(df, {"kind": "ftp", "given": [host, port, user, password, tls, passive]}, remote_path, _format(remote_path, format), options)
        return
    folder, files = _single(df, _format(remote_path, format), options)
    link = _ftp(host, port, user, password, tls, passive)
    try:
        for i, f in enumerate(files or []):
            stream = folder.fs.open(folder.jvm.org.apache.hadoop.fs.Path(f))
            link.storbinary(f"{'STOR' if i == 0 else 'APPE'} {remote_path}.uploading", _Reader(stream), _BLOCK)
            stream.close()
        link.rename(f"{remote_path}.uploading", remote_path)
    finally:
        link.close()
        folder.delete()


def _sftp(host: str, port: int, user: str, password: str | None, private_key: str | None, known_hosts: str | None):
    try:
        import paramiko
    except ImportError as e:
        raise ConfigurationError("SFTP needs the paramiko package") from e
    client = paramiko.SSHClient()
    client.load_host_keys(known_hosts) if known_hosts else client.load_system_host_keys()
    client.set_missing_host_key_policy(paramiko.RejectPolicy())
    client.connect(host, port, user, password, key_filename=private_key, timeout=30)
    return client


@SOURCES.register("sftp")
def read_sftp(spark: SparkSession, host: str, remote_path: str, user: str, port: int = 22, password: str | None = None, private_key: str | None = None, known_hosts: str | None = None, format: str | None = None, delete_after: bool = False, range_bytes: int | None = None, **options) -> DataFrame:
    """A remote file through the source of its format.

    ``delete_after``: in a pipeline the file goes once the task has published; otherwise at once, when it has been fetched.
    """
    login = {"kind": "sftp", "given": [host, port, user, password, private_key, known_hosts]}

    def remove() -> None:
        link = connect(login)
        try:
            link.remove(remote_path)
        finally:
            link.close()

    found = _in_ranges(spark, login, remote_path, _format(remote_path, format), range_bytes, options)
    if found is not None:
        if delete_after:
            found = staged(found)
            later(remove)
        return found
    path, stream = _into(spark, posixpath.basename(remote_path))
    client = _sftp(host, port, user, password, private_key, known_hosts)
    try:
        files = client.open_sftp()
        with files.open(remote_path, "rb") as f:
            while block := f.read(_BLOCK):
                stream.write(bytearray(block))
    finally:
        stream.close()
        client.close()
    if delete_after:
        later(remove)
    return read_source(spark, {"type": _format(remote_path, format), "path": path, **options})


@SINKS.register("sftp")
def write_sftp(df: DataFrame, host: str, remote_path: str, user: str, port: int = 22, password: str | None = None, private_key: str | None = None, known_hosts: str | None = None, format: str | None = None, mode: str | None = None, parts: bool = False, **options) -> None:
    """One remote file, sent under another name and then renamed; or ``parts`` that tasks send, named after it."""
    if parts:
        _send_parts(df, {"kind": "sftp", "given": [host, port, user, password, private_key, known_hosts]}, remote_path, _format(remote_path, format), options)
        return
    folder, files = _single(df, _format(remote_path, format), options)
    client = _sftp(host, port, user, password, private_key, known_hosts)
    try:
        remote = client.open_sftp()
        for i, f in enumerate(files):
            with remote.open(f"{remote_path}.uploading", "ab" if i else "wb") as out:  # never after what a failed try left
                reader = _Reader(folder.fs.open(folder.jvm.org.apache.hadoop.fs.Path(f)))
                while block := reader.read(_BLOCK):
                    out.write(block)
        remote.posix_rename(f"{remote_path}.uploading", remote_path)
    finally:
        client.close()
        folder.delete()
