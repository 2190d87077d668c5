"""Files in byte ranges for tasks: which files there are, and ranged reads of them.

Spark's own readers split files only where every line feed ends a record.  Formats whose records may
hold line feeds are read here by tasks that open a byte range themselves: files with a local
(shared) path, or of a file system that pyarrow knows.  Others stay with Spark's readers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Bytes of a range at most; a task holds one at a time.
RANGE_BYTES = 32 << 20


def range_size(spark: SparkSession) -> int:
    """The size of the session's file partitions, within bounds."""
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1 << 16, min(int(size), RANGE_BYTES))


def files_at(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the data files that ``path``, which may be a folder or a pattern, means; in order."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], list(fs.globStatus(top) or [])
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", "."))]
        else:
            found.append((s.getPath().toString(), int(s.getLen())))
    return sorted(found)


def splittable(address: str) -> bool:
    """False for compressed files, which have no ranges."""
    return address.rsplit(".", 1)[-1].lower() not in ("gz", "bz2", "zst", "lz4", "snappy", "deflate", "xz")


def reachable(address: str) -> bool:
    """Whether tasks can open the file themselves."""
    try:
        with RangedFile(address) as f:
            f.read(0, 1)
        return True
    except Exception:  # any file system that isn't for us
        return False


def plan(files: list[tuple[str, int]], size: int) -> list[list[tuple[str, int, int, int]]]:
    """Ranges (address, file's bytes, first, end) by task: parts of a large file each, small files together."""
    out, held, total = [], [], 0
    for address, length in files:
        if length > size:
            out += [[(address, length, a, min(a + size, length))] for a in range(0, length, size)]
            continue
        if held and total + length > size:
            out.append(held)
            held, total = [], 0
        held.append((address, length, 0, length))
        total += length
    return out + [held] * bool(held)


class RangedFile:
    """A file that is read at given places."""

    def __init__(self, address: str):
        scheme, _, rest = address.partition(":")
        if scheme == "file" or not rest or "/" in scheme:
            local = address if not rest or "/" in scheme else "/" + rest.lstrip("/")
            self._file = open(local, "rb")  # noqa: SIM115
        else:
            from pyarrow.fs import FileSystem

            fs, inner = FileSystem.from_uri(address)
            self._file = fs.open_input_file(inner)

    @property
    def stream(self):
        """The file itself, for formats that seek on their own."""
        return self._file

    def read(self, first: int, end: int) -> bytes:
        self._file.seek(first)
        held = []
        while first < end:
            part = self._file.read(end - first)
            if not part:
                break
            held.append(bytes(part))
            first += len(part)
        return b"".join(held)

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()


def pieces(file: RangedFile, first: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes from ``first`` to ``end``, some at a time."""
    for a in range(first, end, step):
        yield file.read(a, min(a + step, end))
