"""Reading and writing plain workbooks (Office Open XML)."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from array import array
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from tidemill.errors import TidemillError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _place(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


class _Strings:
    """A workbook's shared texts in one block of bytes; a sheet refers to them by number."""

    def __init__(self):
        self.block, self.ends = bytearray(), array("Q", [0])

    def append(self, text: str) -> None:
        self.block += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.block))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < len(self.ends) - 1:
            raise IndexError(i)
        return self.block[self.ends[i] : self.ends[i + 1]].decode("utf-8", "surrogatepass")


def _elements(book: zipfile.ZipFile, name: str, tag: str):
    """The elements of one kind of a zip entry, one after another; each is forgotten before the next one comes.

    Documents that declare types or entities of their own are refused: workbooks have none, and they can grow without bound.
    """
    with book.open(name) as entry:
        if b"<!DOCTYPE" in entry.read(4096):
            raise TidemillError(f"{name} has a document type")
    with book.open(name) as entry:
        open_: list = []
        for event, node in ElementTree.iterparse(entry, ("start", "end")):
            if event == "start":
                open_.append(node)
                continue
            open_.pop()
            if node.tag == tag:
                yield node
                node.clear()
            if open_ and not any(x.tag == tag for x in open_):
                open_[-1].clear()  # what has ended inside, or lies between


def sheet_rows(source, sheet=0):
    """The rows of a sheet by name or index, as lists of values, while its entry is read.

    ``source`` is a file or the bytes of a workbook.
    """
    with zipfile.ZipFile(io.BytesIO(source) if isinstance(source, bytes) else source) as book:
        names = set(book.namelist())
        shared = _Strings()
        if "xl/sharedStrings.xml" in names:
            for si in _elements(book, "xl/sharedStrings.xml", _MAIN + "si"):
                shared.append(_text(si))
        dated = []
        if "xl/styles.xml" in names:
            custom, block = set(), []
            for f in _elements(book, "xl/styles.xml", _MAIN + "numFmt"):
                if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", ""))):
                    custom.add(int(f.get("numFmtId")))
            for xfs in _elements(book, "xl/styles.xml", _MAIN + "cellXfs"):
                block = [int(x.get("numFmtId", 0)) for x in xfs]
            dated = [x in _DATE_FORMATS | custom for x in block]
        sheets = [(s.get("name"), s.get(_REL)) for s in _elements(book, "xl/workbook.xml", _MAIN + "sheet")]
        chosen = sheets[sheet][1] if isinstance(sheet, int) else next(i for n, i in sheets if n == sheet)
        targets = {r.get("Id"): r.get("Target") for r in _elements(book, "xl/_rels/workbook.xml.rels", "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship")}
        target = targets[chosen].lstrip("/")
        for row in _elements(book, target if target.startswith("xl/") else "xl/" + target, _MAIN + "row"):
            cells: list = []
            for c in row.iter(_MAIN + "c"):
                at = _place(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _cell(c, shared, dated)
            yield cells


def read_workbook(source, sheet=0, header_row: int = 1, skip_rows: int = 0):
    """(names, rows as they are read) of a sheet.  Blank cells are null, dates ISO text, empty rows left out."""
    rows = sheet_rows(source, sheet)
    head: list = []
    for _ in range(header_row):
        head = next(rows, [])
    names = [str(v) if v is not None else f"column_{i + 1}" for i, v in enumerate(head)] if header_row else []

    def body():
        for i, r in enumerate(rows):
            if i >= skip_rows and any(v is not None for v in r):
                yield r[: len(names)] if header_row else r

    return names, body()


def _cell(c, shared: list[str], dated: list[bool]):
    kind, value = c.get("t", "n"), c.find(_MAIN + "v")
    if kind == "inlineStr":
        return _text(c).strip() or None
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)].strip() or None
    if kind == "b":
        return value.text == "1"
    if kind in ("str", "d"):
        return value.text.strip() or None
    if kind == "e":
        return None
    x, style = float(value.text), int(c.get("s", 0))
    if style < len(dated) and dated[style]:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=x)
        return moment.isoformat()
    return x


def _row_xml(row) -> str:
    cells = []
    for v in row:
        if v is None or v == "":
            cells.append("<c/>")
        elif isinstance(v, bool):
            cells.append(f'<c t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)):
            cells.append(f"<c><v>{v!r}</v></c>")
        else:
            clean = re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "\ufffd", str(v))
            cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
    return f"<row>{''.join(cells)}</row>"


def write_workbook(out, sheet: str, rows) -> None:
    """Write a workbook with one sheet of texts, numbers and booleans to a binary stream, a row at a time."""
    main = _MAIN[1:-1]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as entry:
            entry.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for row in rows:
                entry.write(_row_xml(row).encode())
            entry.write(b"</sheetData></worksheet>")
