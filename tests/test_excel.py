import io
import tracemalloc
import zipfile

import pytest

from tidemill.errors import TidemillError
from tidemill.sources.base import read_source, write_sink
from tidemill.sources.excel import read_workbook, sheet_rows, write_workbook


def book(rows, sheet="S"):
    out = io.BytesIO()
    write_workbook(out, sheet, rows)
    return out.getvalue()


def test_rows_stream_both_ways(tmp_path):
    """A large sheet takes little memory, whether it's written or read."""
    path, n = tmp_path / "big.xlsx", 60_000
    tracemalloc.start()
    with path.open("wb") as f:
        write_workbook(f, "S", ([i, f"text {i}", i % 2 == 0] for i in range(n)))
    with path.open("rb") as f:
        count = sum(1 for i, row in enumerate(sheet_rows(f)) if row == [float(i), f"text {i}", i % 2 == 0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and peak < 8 << 20


def test_shared_texts_dates_and_gaps():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    data = book([["a"]])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if "sheet1" not in name:
                new.writestr(name, old.read(name))
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch é</t></r></si><si><t> </t></si></sst>')
        new.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        new.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3" s="1"><v>1.5</v></c><c r="C3" s="2"><v>2</v></c></row><row><c t="s"><v>2</v></c><c t="e"><v>#N/A</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
    names, rows = read_workbook(out.getvalue())
    assert names == ["name", "column_2", "rich é"]
    assert list(rows) == [["1899-12-31T12:00:00", None, "1900-01-01T00:00:00"], [None, None, True]]


def test_document_types_are_refused():
    data = book([["a"], ["b"]])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, (b'<!DOCTYPE x [<!ENTITY a "aaaa">]>' if "sheet1" in name else b"") + old.read(name))
    with pytest.raises(TidemillError):
        list(sheet_rows(out.getvalue()))


def test_types_hold_for_all_workbooks(spark, tmp_path):
    for name, rows in (("a", [["n", "m", "b"], [1, 2, True]]), ("b", [["n", "m", "b"], ["x", 3.5, False], [None, None, None]]), ("c", [["n", "m", "b"], [None, 4, "t"]])):
        (tmp_path / f"{name}.xlsx").write_bytes(book(rows))
    df = read_source(spark, {"type": "excel", "path": str(tmp_path)})
    assert df.dtypes == [("n", "string"), ("m", "double"), ("b", "string")]
    assert sorted(map(str, df.collect())) == sorted(["Row(n='1.0', m=2.0, b='True')", "Row(n='x', m=3.5, b='False')", "Row(n=None, m=4.0, b='t')"])
    plain = read_source(spark, {"type": "excel", "path": str(tmp_path / "a.xlsx"), "header_row": 0})
    assert plain.columns == ["column_1", "column_2", "column_3"] and plain.count() == 2


def test_sink_streams_and_refuses_too_many_rows(spark, tmp_path, monkeypatch):
    from tidemill.sources import files

    df = spark.range(500).selectExpr("id", "concat('n', id) AS name")
    target = {"type": "excel", "path": str(tmp_path / "t.xlsx")}
    write_sink(df, target)
    assert read_source(spark, target).count() == 500
    monkeypatch.setattr(files, "SHEET_ROWS", 100)
    with pytest.raises(TidemillError):
        write_sink(df, target)
    monkeypatch.undo()
    assert read_source(spark, target).count() == 500 and len(list(tmp_path.glob("*.xlsx"))) == 1
