"""FTP and SFTP as Spark data sources: tasks read byte ranges of one remote file and send part files.

A range is read from its offset (``REST`` of FTP, a seek of SFTP), so one large file is
fetched over as many connections as tasks run.  A sending task stores its part under a
name that nothing else uses; once all tasks are through, the commit renames the parts,
and an abort removes them.
"""

from __future__ import annotations

import ftplib
import io
import json
import posixpath
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_BLOCK = 1 << 20


class FtpLink:
    """A connection to an FTP server."""

    def __init__(self, host: str, port: int, user: str, password: str, tls: bool, passive: bool):
        self.link = (ftplib.FTP_TLS if tls else ftplib.FTP)()
        self.link.connect(host, port, timeout=30)
        self.link.login(user, password)
        if tls:
            self.link.prot_p()
        self.link.set_pasv(passive)
        self.link.voidcmd("TYPE I")

    def size(self, path: str) -> int:
        return self.link.size(path)

    def read(self, path: str, first: int, end: int) -> bytes:
        """The bytes from ``first`` to ``end`` or the file's end; the transfer stops there."""
        held, left = [], end - first
        data = self.link.transfercmd(f"RETR {path}", rest=first)
        try:
            while left and (block := data.recv(min(left, _BLOCK))):
                held.append(block)
                left -= len(block)
        finally:
            data.close()
        try:
            self.link.voidresp()
        except ftplib.error_temp:  # the server has noticed that the transfer was cut short
            pass
        return b"".join(held)

    def store(self, path: str, source) -> None:
        self.link.storbinary(f"STOR {path}", source, _BLOCK)

    def rename(self, old: str, new: str) -> None:
        self.link.rename(old, new)

    def remove(self, path: str) -> None:
        self.link.delete(path)

    def close(self) -> None:
        self.link.close()


class SftpLink:
    """A connection to an SFTP server."""

    def __init__(self, *login):
        from tidemill.sources import remote

        self.client = remote._sftp(*login)
        self.files = self.client.open_sftp()

    def size(self, path: str) -> int:
        return self.files.stat(path).st_size

    def read(self, path: str, first: int, end: int) -> bytes:
        with self.files.open(path, "rb") as f:
            f.seek(first)
            held, left = [], end - first
            while left and (block := f.read(min(left, _BLOCK))):
                held.append(block)
                left -= len(block)
            return b"".join(held)

    def store(self, path: str, source) -> None:
        with self.files.open(path, "wb") as out:
            while block := source.read(_BLOCK):
                out.write(block)

    def rename(self, old: str, new: str) -> None:
        self.files.posix_rename(old, new)

    def remove(self, path: str) -> None:
        self.files.remove(path)

    def close(self) -> None:
        self.client.close()


def connect(login: dict) -> FtpLink | SftpLink:
    """``login``: its ``kind``, ftp or sftp, and ``given``, what the link takes."""
    return {"ftp": FtpLink, "sftp": SftpLink}[login["kind"]](*login["given"])


class RemoteFile:
    """A remote file that is read at given places, over one connection."""

    def __init__(self, login: dict, path: str):
        self.link, self.path = connect(login), path

    def read(self, first: int, end: int) -> bytes:
        return self.link.read(self.path, first, end) if first < end else b""

    def __enter__(self) -> RemoteFile:
        return self

    def __exit__(self, *_) -> None:
        self.link.close()


class LineRange(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def lines(file, length: int, first: int, end: int, block: int = _BLOCK) -> Iterator[bytes]:
    """The lines whose first byte lies from ``first`` up to ``end``; the last one may go on beyond it."""
    at = max(first - 1, 0)
    start = None if first else 0  # of the line in ``held``; none: it's the one before ours
    held: list[bytes] = []
    while at < length and (data := file.read(at, min(at + block, length))):
        at += len(data)
        if start is None:
            cut = data.find(b"\n")
            if cut < 0:
                continue
            data = data[cut + 1 :]
            start = at - len(data)
        held.append(data)
        if b"\n" in data:
            *whole, rest = b"".join(held).split(b"\n")
            held = [rest]
            for line in whole:
                if start >= end:
                    return
                yield line
                start += len(line) + 1
        if start >= end:
            return
    last = b"".join(held)
    if last and start is not None and start < end:
        yield last


class RemoteLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o, self.login = json.loads(options["how"]), json.loads(options["secret_login"])

    def partitions(self) -> list[LineRange]:
        size, step = self.o["size"], self.o["range"]
        return [LineRange(a, min(a + step, size)) for a in range(0, size, step)]

    def read(self, partition: LineRange) -> Iterator[tuple[str]]:
        with RemoteFile(self.login, self.o["path"]) as file:
            for line in lines(file, self.o["size"], partition.first, partition.end):
                yield (line.decode(self.o["encoding"]),)


class RemoteLines(DataSource):
    """The lines of one remote file."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_remote_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> RemoteLinesReader:
        return RemoteLinesReader(self.options)


class PartSent(WriterCommitMessage):
    def __init__(self, number: int, name: str, rows: int):
        self.number, self.name, self.rows = number, name, rows


class _Lines(io.RawIOBase):
    """Lines as a binary stream."""

    def __init__(self, rows, head: bytes):
        self.rows, self.held, self.count = iter(rows), head, 0

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        parts, total = [self.held], len(self.held)
        while size < 0 or total < size:
            row = next(self.rows, None)
            if row is None:
                break
            parts.append(row[0].encode() + b"\n")
            total += len(parts[-1])
            self.count += 1
        data = b"".join(parts)
        cut = len(data) if size < 0 else size
        self.held = data[cut:]
        return data[:cut]


def part_name(path: str, number: int) -> str:
    """``/x/rows.csv`` to ``/x/rows-00007.csv``."""
    stem, end = posixpath.splitext(path)
    return f"{stem}-{number:05d}{end}"


class RemotePartsWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.o, self.login = json.loads(options["how"]), json.loads(options["secret_login"])

    def write(self, iterator) -> PartSent:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId()
        name = f"{part_name(self.o['path'], number)}.{self.o['run']}-{task.taskAttemptId()}.uploading"
        rows = iter(iterator)
        first = next(rows, None)
        if first is None and number:
            return PartSent(number, "", 0)  # no part for no rows, but for the first one
        stream = _Lines((r for part in ([first] if first is not None else [], rows) for r in part), self.o["head"].encode())
        link = connect(self.login)
        try:
            link.store(name, stream)
        finally:
            link.close()
        return PartSent(number, name, stream.count)

    def commit(self, messages: list) -> None:
        """All parts get their names; those of before with the same names are replaced."""
        link = connect(self.login)
        try:
            for m in messages:
                if m is not None and m.name:
                    link.rename(m.name, part_name(self.o["path"], m.number))
        finally:
            link.close()

    def abort(self, messages: list) -> None:
        link = connect(self.login)
        try:
            for m in messages:
                if m is not None and m.name:
                    link.remove(m.name)
        finally:
            link.close()


class RemoteParts(DataSource):
    """Lines (value) that tasks send as parts of one remote file."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_remote_parts"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> RemotePartsWriter:
        return RemotePartsWriter(self.options)
