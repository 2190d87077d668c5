"""Files: CSV, JSON, XML, Parquet, Excel."""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.errors import ConfigurationError
from tidemill.functions.columns import as_text, col, names_of, quoted, strip
from tidemill.plans.staging import staging_dir
from tidemill.shipping import ship_package
from tidemill.sources.base import SINKS, SOURCES, Folder, mode_of, publish
from tidemill.sources.excel import read_workbook, write_workbook
from tidemill.sources.ranges import RangedFile, files_at, range_size, reachable, splittable
from tidemill.sources.split_json import elements_frame, read_documents
from tidemill.sources.split_csv import Grammar, SplitCsv, first_record, opened

#: Texts that a CSV cell may use for null.
NULL_WORDS = ("", "NULL", "null", "NA", "N/A")


#: Encodings where the bytes of ASCII characters mean nothing else.
_ASCII_BASED = re.compile(r"(utf_?8|ascii|us_?ascii|latin_?1|iso_?8859_?\d+|cp125\d|windows_?125\d)")


@SOURCES.register("csv")
def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quotechar: str = '"', encoding: str = "utf-8", skip_rows: int = 0, columns=None, has_header: bool = True, null_values=NULL_WORDS, strip_whitespace: bool = True, max_columns: int = 4096, multiline: bool | None = None, range_bytes: int | None = None) -> DataFrame:
    """All columns as text, trimmed, with the null words as null.

    With ``columns`` those are the names, and a header row is passed over.  ``skip_rows``
    physical lines of each file are left out before its header.  Cells may hold line feeds:
    files of over ``range_bytes`` (by default the session's size of file partitions, 32 MB at
    most) are read in ranges of that size, each by a task that finds its records' borders
    itself (:mod:`tidemill.sources.split_csv`), smaller ones whole.  Files that
    tasks can't open in ranges (compressed, UTF-16, on a file system only Spark reaches) are
    read by one task each, unless ``multiline=False`` says that no cell has line feeds.
    """
    given = names_of(columns)
    files = files_at(spark, path)
    range_bytes = range_bytes or range_size(spark)
    tidy = encoding.lower().replace("-", "_")
    ranged = bool(files) and len(delimiter) == 1 and len(quotechar) <= 1 and bool(_ASCII_BASED.fullmatch(tidy)) and all(splittable(f) for f, _ in files) and reachable(files[0][0])
    if ranged and (skip_rows or multiline is None and max(n for _, n in files) > range_bytes):
        df = _ranges(spark, files, delimiter, quotechar, encoding, skip_rows, given, has_header, range_bytes)
    elif skip_rows:
        df = _skipped(spark, path, delimiter, quotechar, encoding, skip_rows, given, has_header)
    else:
        reader = spark.read.option("sep", delimiter).option("quote", quotechar).option("escape", quotechar).option("encoding", encoding).option("maxColumns", max_columns)
        reader = reader.option("mode", "PERMISSIVE").option("nullValue", "\x00never").option("emptyValue", "").option("header", has_header)
        reader = reader.option("multiLine", multiline is not False)
        if given:
            reader = reader.option("enforceSchema", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in given]))
        df = reader.csv(path)
    return _cleaned(df, null_values, strip_whitespace)


def read_csv_ranges(spark: SparkSession, path: str, size: int, login: dict, range_bytes: int, delimiter: str = ",", quotechar: str = '"', encoding: str = "utf-8", skip_rows: int = 0, columns=None, has_header: bool = True, null_values=NULL_WORDS, strip_whitespace: bool = True) -> DataFrame:
    """A remote file of ``size`` bytes as :func:`read_csv` gives it, in ranges that tasks fetch themselves."""
    df = _ranges(spark, [(path, size)], delimiter, quotechar, encoding, skip_rows, names_of(columns), has_header, range_bytes, login)
    return _cleaned(df, null_values, strip_whitespace)


def _cleaned(df: DataFrame, null_values, strip_whitespace: bool) -> DataFrame:
    words = list(null_values)

    def clean(name: str) -> Column:
        c = strip(col(name)) if strip_whitespace else col(name)
        return F.when(~c.isin(words), c).alias(name.strip())

    return df.select(*(clean(c) for c in df.columns))


def _named(cells: list[str]) -> list[str]:
    """Names of a header's cells; blank ones by their place, repeated ones with it."""
    cells = [c.strip() for c in cells]
    return [c if c and cells.count(c) == 1 else f"{c or '_c'}{i}" for i, c in enumerate(cells)]


def _ranges(spark: SparkSession, files, delimiter: str, quotechar: str, encoding: str, skip_rows: int, given: list[str], has_header: bool, range_bytes: int, login: dict | None = None) -> DataFrame:
    grammar = Grammar(delimiter, quotechar)
    names = given
    for address, length in files if not given else ():
        with opened(address, login) as file:
            record = first_record(file, length, grammar, skip_rows).decode(encoding)
        if record.strip():
            cells = next(csv.reader([record], delimiter=delimiter, quotechar=quotechar or None))
            names = _named(cells) if has_header else [f"_c{i}" for i in range(len(cells))]
            break
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    how = {"files": files, "names": names, "delimiter": delimiter, "quote": quotechar, "encoding": encoding, "skip_rows": skip_rows, "header": has_header, "range": range_bytes}
    ship_package(spark)
    spark.dataSource.register(SplitCsv)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.format(SplitCsv.name()).schema(schema).option("how", json.dumps(how))
    return (reader.option("secret_login", json.dumps(login)) if login else reader).load()


def _skipped(spark: SparkSession, path: str, delimiter: str, quotechar: str, encoding: str, skip_rows: int, given: list[str], has_header: bool) -> DataFrame:
    """Files that only Spark can open: each whole in one task, which skips its first lines."""

    def body(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: "\n".join(re.split(r"\r?\n", bytes(b).decode(encoding))[skip_rows:]))

    texts = spark.read.format("binaryFile").load(path).select(F.col("path").alias("__file"), F.pandas_udf(body, "string")("content").alias("v"))
    lines = texts.select("__file", F.posexplode(F.split("v", "\n")).alias("__n", "value"))
    if has_header or not given:
        header = lines.where("__n = 0").orderBy("__file").select("value").first()
        if header is None or not header[0]:
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in given]))
        cells = next(csv.reader([header[0]], delimiter=delimiter, quotechar=quotechar))
        given = given or (_named(cells) if has_header else [f"_c{i}" for i in range(len(cells))])
    lines = lines.where("value <> ''")
    lines = lines.where("__n > 0") if has_header else lines
    schema = ", ".join(f"{quoted(n.strip())} string" for n in given)
    return lines.select(F.from_csv("value", schema, {"sep": delimiter, "quote": quotechar, "escape": quotechar}).alias("r")).select("r.*")


@SOURCES.register("json", "jsonl", "ndjson")
def read_json(spark: SparkSession, path: str, format: str = "auto", root: str | None = None, encoding: str = "utf-8", strict: bool = True, range_bytes: int | None = None) -> DataFrame:
    """JSON lines, or whole documents whose array (at ``root``) holds the records; what is no object becomes ``value``.

    A document of over ``range_bytes`` (by default the session's size of file partitions, 32 MB
    at most) is cut into its array's elements by many tasks (:mod:`tidemill.sources.split_json`), which are staged as lines.
    """
    lines = format == "lines" or (format == "auto" and path.rstrip("/").rsplit(".", 1)[-1] in ("jsonl", "ndjson"))
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    if lines and not root:
        return spark.read.option("mode", mode).option("encoding", encoding).json(path)
    if not lines and encoding.lower().replace("-", "") == "utf8":
        size, files = range_bytes or range_size(spark), files_at(spark, path)
        if files and max(n for _, n in files) > size and all(splittable(f) for f, _ in files) and reachable(files[0][0]):
            return elements_frame(spark, read_documents(spark, files, root, strict, size, staging_dir(spark)), strict)
    df = spark.read.option("multiLine", not lines).option("mode", mode).option("encoding", encoding).json(path)
    if not root:
        return df
    at = F.col(".".join(quoted(p) for p in root.split(".")))
    found = df.select(at.alias("r"))
    kind = found.schema["r"].dataType
    if isinstance(kind, T.ArrayType):
        found, kind = found.select(F.explode("r").alias("r")), kind.elementType
    return found.select("r.*") if isinstance(kind, T.StructType) else found.withColumnRenamed("r", "value")


@SOURCES.register("xml")
def read_xml(spark: SparkSession, path: str, record_tag: str, attributes: bool = True, text_key: str = "#text") -> DataFrame:
    """One row for each ``record_tag`` element; attributes are ``@name``, repeated tags lists, prefixes dropped."""
    reader = spark.read.option("rowTag", record_tag).option("attributePrefix", "@").option("valueTag", text_key)
    return reader.option("ignoreNamespace", True).option("excludeAttribute", not attributes).option("nullValue", "").xml(path)


@SOURCES.register("parquet")
def read_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """A file or folder with its partition columns; only ``columns`` are read if given."""
    df = spark.read.parquet(path)
    return df.select(*(col(c) for c in names_of(columns))) if columns else df


@SOURCES.register("excel", "xlsx")
def read_excel(spark: SparkSession, path: str, sheet=0, header_row: int = 1, skip_rows: int = 0, columns=None) -> DataFrame:
    """Rows of one sheet, for each file that ``path`` matches.

    Each workbook is read by one task, row by row.  A first pass over all workbooks finds the kinds of
    values in each column: it is text but for numbers and booleans that hold for the whole column of all of them.
    """
    found = files_at(spark, path)
    if not found:
        raise ConfigurationError(f"no workbook at {path}")
    if reachable(found[0][0]):  # a task opens the file itself and never holds it whole
        files = spark.createDataFrame([(f, None) for f, _ in found], "address string, content binary").repartition(len(found))
    else:
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("address"), "content")
    names = names_of(columns)

    def books(batches):
        for pdf in batches:
            for address, content in zip(pdf["address"], pdf["content"]):
                if content is not None:
                    yield address, read_workbook(bytes(content), sheet, header_row, skip_rows)
                    continue
                with RangedFile(address) as file:
                    yield address, read_workbook(file.stream, sheet, header_row, skip_rows)

    def first_pass(batches):
        for address, (head, body) in books(batches):
            kinds = [set() for _ in head]
            for row in body:
                kinds += [set() for _ in row[len(kinds) :]]  # without a header, rows say how many columns there are
                for k, v in zip(kinds, row):
                    if v is not None:
                        k.add(type(v).__name__)
            head += [f"column_{i + 1}" for i in range(len(head), len(kinds))]
            yield pd.DataFrame({"address": address, "at": range(len(head)), "name": head, "kinds": [sorted(k) for k in kinds]})

    facts = files.mapInPandas(first_pass, "address string, at int, name string, kinds array<string>")
    by_column = facts.groupBy("at").agg(F.min(F.struct("address", "name"))["name"].alias("name"), F.array_distinct(F.flatten(F.collect_set("kinds"))).alias("kinds"))
    held = {r["at"]: r for r in by_column.collect()}
    if not held:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    names = names or [held[i]["name"] for i in sorted(held)]
    kinds = [{("bool",): "boolean", ("float",): "double"}.get(tuple(held[i]["kinds"]) if i in held else (), "string") for i in range(len(names))]

    def second_pass(batches):
        for _, (_, body) in books(batches):
            out = []
            for r in body:
                out.append([None if i >= len(r) or r[i] is None else r[i] if k != "string" else str(r[i]) for i, k in enumerate(kinds)])
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(second_pass, ", ".join(f"{quoted(n)} {k}" for n, k in zip(names, kinds)))


# ---- sinks -----------------------------------------------------------------------------------


def csv_cells(df: DataFrame, columns=None, escape_formulas: bool = True, null_value: str = "") -> DataFrame:
    """Every cell as CSV text: true/false, JSON for nested values, and an apostrophe before what a spreadsheet would run."""
    out = []
    for name in names_of(columns) or df.columns:
        kind = df.schema[name].dataType if name in df.columns else T.StringType()
        c = F.lit(None).cast("string") if name not in df.columns else F.lower(as_text(col(name), kind)) if isinstance(kind, T.BooleanType) else as_text(col(name), kind)
        if escape_formulas:
            c = F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)
        shown = "'" + name if escape_formulas and name[:1] in "=+-@\t\r" else name
        out.append(F.coalesce(c, F.lit(null_value)).alias(shown))
    return df.select(*out)


@SINKS.register("csv")
def write_csv(df: DataFrame, path: str, mode: str | None = None, delimiter: str = ",", encoding: str = "utf-8", columns=None, write_header: bool = True, escape_formulas: bool = True, null_value: str = "") -> None:
    """A folder of CSV parts, published whole."""
    mode = mode_of(mode, ("append", "overwrite", "error_if_exists"))
    cells = csv_cells(df, columns, escape_formulas, null_value)
    publish(cells, path, mode, lambda w, p: w.option("header", write_header).option("sep", delimiter).option("encoding", encoding).option("escape", '"').option("emptyValue", "").csv(p))


@SINKS.register("json", "jsonl", "ndjson")
def write_json(df: DataFrame, path: str, mode: str | None = None, format: str = "lines", ensure_ascii: bool = False) -> None:
    """JSON lines with all fields, or one array in each part file."""
    if format == "lines":
        publish(df, path, mode_of(mode, ("append", "overwrite", "error_if_exists")), lambda w, p: w.option("ignoreNullFields", False).json(p))
        return
    mode = mode_of(mode, ("overwrite", "error_if_exists"))
    names = df.columns

    def arrays(batches):
        import pandas as pd

        first = True
        for pdf in batches:
            for row in pdf["value"]:
                yield pd.DataFrame({"value": [("[" if first else ",") + row]})
                first = False
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    rows = df.select(F.to_json(F.struct(*(col(c) for c in names)), {"ignoreNullFields": "false"}).alias("value"))
    publish(rows.mapInPandas(arrays, "value string"), path, mode, lambda w, p: w.text(p))


@SINKS.register("xml")
def write_xml(df: DataFrame, path: str, mode: str | None = None, root_tag: str = "records", record_tag: str = "record") -> None:
    """XML parts of plain text elements; names become valid tags and illegal characters U+FFFD."""
    cells = []
    for name in df.columns:
        tag = re.sub(r"[^\w.-]", "_", name)
        tag = tag if re.match(r"[A-Za-z_]", tag) else "_" + tag
        text = as_text(col(name), df.schema[name].dataType)
        cells.append(F.regexp_replace(text, "[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "�").alias(tag))
    mode = mode_of(mode, ("overwrite", "error_if_exists"))
    publish(df.select(*cells), path, mode, lambda w, p: w.option("rootTag", root_tag).option("rowTag", record_tag).xml(p))


@SINKS.register("parquet")
def write_parquet(df: DataFrame, path: str, mode: str | None = None, compression: str = "snappy") -> None:
    """A Parquet folder, published whole."""
    publish(df, path, mode_of(mode, ("overwrite", "error_if_exists")), lambda w, p: w.option("compression", compression).parquet(p))


#: Rows of one sheet at most, its header included.
SHEET_ROWS = 1_048_576


@SINKS.register("excel", "xlsx")
def write_excel(df: DataFrame, path: str, mode: str | None = None, sheet: str = "Sheet1", columns=None, write_header: bool = True, escape_formulas: bool = True) -> None:
    """One workbook, whose rows stream through the driver; more than a sheet can hold are an error."""
    mode = mode_of(mode, ("overwrite", "error_if_exists"))
    cells = csv_cells(df, columns, escape_formulas)
    target = Folder(df.sparkSession, path)
    if mode == "error_if_exists" and target.exists():
        raise ConfigurationError(f"{path} exists already")

    def rows():
        if write_header:
            yield cells.columns
        for i, row in enumerate(cells.toLocalIterator()):
            if i >= SHEET_ROWS - write_header:
                raise ConfigurationError(f"a sheet holds at most {SHEET_ROWS} rows")
            yield row

    staging = target.sibling()
    stream = _Out(staging.fs.create(staging.path, True))
    try:
        write_workbook(stream, sheet, rows())
        stream.close()
    except Exception:
        stream.close()
        staging.delete()
        raise
    if target.exists():
        target.delete()
    staging.rename(target)


class _Out(io.BufferedIOBase):
    """A Hadoop output stream as a Python one that only goes forward."""

    def __init__(self, stream):
        self.stream, self.held = stream, bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.held += data
        if len(self.held) >= 1 << 20:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.stream.write(self.held)
            self.held = bytearray()

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.stream.close()
        super().close()
