"""CSV whose cells may hold line feeds, read by many tasks without a first pass.

A record belongs to the range that its first byte lies in.  A task finds where records begin near the two ends of its
range from the bytes before them.  Read as a machine of four states (at the
start of a cell, in a plain cell, in a quoted cell, after a quote in a quoted cell), an ordinary character, a quote and
a delimiter or line end lead from each state to the start of a cell.  So the last such
sequence before a place tells the state there, whatever comes before; a quote inside a plain cell
(``5" pipe``) changes nothing.

Where no quote at all is near, line ends are taken to end records.  The task whose range ends there
checks that against its own bytes, from a place it knows, and fails if a quoted cell runs
across; each range vouches for the next one, so rows are right or there is an error.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemill.errors import ConfigurationError
from tidemill.sources.ranges import RangedFile, pieces, plan

#: Bytes before a place that are searched for a quote at first; four times as many each time, up to the most.
LOOK_BACK, MOST_BACK = 1 << 16, 1 << 20
_STEP = 1 << 18
_MARK = b"\xef\xbb\xbf"


class Grammar:
    """Where records of a dialect begin."""

    def __init__(self, delimiter: str, quote: str):
        d, q = re.escape(delimiter.encode()), re.escape(quote.encode())
        self.quote = quote.encode()
        self.sync = re.compile(b"[^%s%s\r\n]%s[%s\r\n]" % (q, d, q, d)) if quote else None
        plain = b"[^%s%s\r\n][^%s\r\n]*+" % (q, d, d) if quote else b"[^%s\r\n]++" % d
        quoted = b"%s[^%s]*+(?:%s%s[^%s]*+)*+%s(?!%s)[^%s\r\n]*+|" % (q, q, q, q, q, q, q, d) if quote else b""
        cell = b"(?:%s%s|)" % (quoted, plain)
        # what follows is seen too, so that an end of the buffer isn't taken for one of the record
        self.rest = re.compile(b"%s(?:%s%s)*+(?:\r\n|\n|\r(?!\\Z))" % (cell, d, cell))
        self.after = re.compile(b"(?:%s%s)*+(?:\r\n|\n|\r(?!\\Z))" % (d, cell))

    def start(self, file: RangedFile, length: int, begin: int, place: int) -> tuple[int, bool]:
        """(the first record start from ``place`` on, whether that is certain); ``begin`` is one, and the end of the file counts as one."""
        if place <= begin:
            return begin, True
        if place >= length:
            return length, True
        back = LOOK_BACK
        while True:
            first = max(begin, place - back)
            data = file.read(first, place)
            if first == begin:
                return self._walk(file, length, begin, place, self.rest), True
            found = None
            for found in self.sync.finditer(data) if self.sync else ():
                pass
            if found:
                at = first + found.end() - 1
                # the delimiter or line end itself comes next
                return self._walk(file, length, at, place, self.after), True
            if back >= MOST_BACK and (not self.quote or self.quote not in data):
                cut = max(data.rfind(b"\n"), data.rfind(b"\r"))
                if cut >= 0:
                    return self._walk(file, length, first + cut + 1, place, self.rest), not self.quote
            back *= 4

    def _walk(self, file: RangedFile, length: int, at: int, place: int, how) -> int:
        """The first record end from ``place`` on, over the records from ``at`` on; the first of them goes by ``how``."""
        size = _STEP
        while at < place:
            data = file.read(at, min(at + size, length))
            used = 0
            while at + used < place:
                found = how.match(data, used)
                if not found:
                    break
                used, how = found.end(), self.rest
            if not used:
                if at + len(data) >= length:
                    return length  # the last record has no line end
                size *= 2
            at += used
        return at

    def vouch(self, data: bytes) -> bool:
        """Whether ``data``, which begins at a record start, ends with one that's whole."""
        if not self.quote or self.quote not in data:
            return True
        at = 0
        for found in self.sync.finditer(data):
            at = found.end() - 1
        how = self.after if at else self.rest
        while at < len(data):
            found = how.match(data, at)
            if not found:
                return False
            at, how = found.end(), self.rest
        return True


class CsvRange(InputPartition):
    def __init__(self, ranges: list):
        self.ranges = ranges


class SplitCsvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = json.loads(options["how"])
        self.names = self.o["names"]
        self.login = json.loads(options["secret_login"]) if "secret_login" in options else None

    def partitions(self) -> list[CsvRange]:
        return [CsvRange(r) for r in plan([tuple(f) for f in self.o["files"]], self.o["range"])]

    def read(self, partition: CsvRange) -> Iterator:
        for address, length, first, end in partition.ranges:
            with opened(address, self.login) as file:
                yield from self._range(file, address, length, first, end)

    def _range(self, file: RangedFile, address: str, length: int, first: int, end: int) -> Iterator:
        o = self.o
        grammar = Grammar(o["delimiter"], o["quote"])
        begin = body_start(file, length, grammar, o["skip_rows"], o["header"])
        start, _ = grammar.start(file, length, begin, max(first, begin))
        stop, certain = grammar.start(file, length, begin, max(end, begin))
        if start == stop:
            return
        data = file.read(start, stop)
        if start > stop or not certain and not grammar.vouch(data):
            raise ConfigurationError(f"{address}: a quoted cell of over {MOST_BACK} bytes goes across byte {end}; read it with multiline=True")
        yield from batches(data, self.names, o["delimiter"], o["quote"], o["encoding"])


def opened(address: str, login: dict | None = None):
    """A file of a file system, or of the server that ``login`` is for."""
    if login is None:
        return RangedFile(address)
    from tidemill.sources.remote_parts import RemoteFile

    return RemoteFile(login, address)


def body_start(file: RangedFile, length: int, grammar: Grammar, skip_rows: int, header: bool) -> int:
    """Where the first record begins after a byte order mark, ``skip_rows`` lines and a header."""
    at = 3 if file.read(0, 3) == _MARK else 0
    left = skip_rows
    while left and at < length:
        for part in pieces(file, at, length):
            lines = part.count(b"\n")
            if lines < left:
                left -= lines
                at += len(part)
                continue
            for _ in range(left):
                cut = part.index(b"\n") + 1
                part, at = part[cut:], at + cut
            left = 0
            break
    if header and at < length:
        # lines without any text don't count
        while at < length and not file.read(at, at + 1).strip(b"\r\n"):
            at += 1
        at = grammar._walk(file, length, at, min(at + 1, length), grammar.rest)
    return at


def first_record(file: RangedFile, length: int, grammar: Grammar, skip_rows: int) -> bytes:
    """The record that follows the skipped lines."""
    at = body_start(file, length, grammar, skip_rows, False)
    return file.read(at, body_start(file, length, grammar, skip_rows, True))


def batches(data: bytes, names: list[str], delimiter: str, quote: str, encoding: str) -> Iterator:
    """Arrow batches of text columns; short rows end with nulls, and what is too much goes."""
    import pyarrow as pa
    from pyarrow import csv as arrow

    if not data.strip(b"\r\n"):
        return
    if encoding.lower().replace("-", "") == "utf8":
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode(errors="replace").encode()
    odd = []

    def ragged(row) -> str:
        odd.append(row.actual_columns)
        return "skip"

    read = arrow.ReadOptions(column_names=[str(i) for i in range(len(names))], use_threads=False, block_size=max(len(data), 1 << 16) + 1, encoding=encoding)
    parse = arrow.ParseOptions(delimiter=delimiter, quote_char=quote or False, double_quote=True, newlines_in_values=True, ignore_empty_lines=True, invalid_row_handler=ragged)
    convert = arrow.ConvertOptions(column_types={str(i): pa.string() for i in range(len(names))}, strings_can_be_null=False, quoted_strings_can_be_null=False, null_values=[])
    table = arrow.read_csv(pa.BufferReader(data), read, parse, convert)
    if odd:  # row by row, so that rows keep their order
        csv.field_size_limit(1 << 31)
        rows = csv.reader(io.StringIO(data.decode(encoding), newline=""), delimiter=delimiter, quotechar=quote or None, quoting=csv.QUOTE_MINIMAL if quote else csv.QUOTE_NONE)
        n = len(names)
        full = [(r + [None] * n)[:n] for r in rows if r]
        table = pa.table({str(i): pa.array([r[i] for r in full], pa.string()) for i in range(n)})
    for batch in table.rename_columns(names).to_batches(max_chunksize=1 << 14):
        yield batch


class SplitCsv(DataSource):
    """The ranges of some files as a Spark data source; its one option holds the dialect, names and files as JSON."""

    @classmethod
    def name(cls) -> str:
        return "tidemill_csv"

    def reader(self, schema) -> SplitCsvReader:
        return SplitCsvReader(self.options)
