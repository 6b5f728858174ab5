"""Workbooks in the zipped XML format: the cells of the active sheet as text, read by tasks, one workbook in each.

Formulas show the value that was stored with them. Numbers whose cells are shown as dates or times read ``2026-01-31 00:00:00``. Older binary workbooks are not read.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: name spaces of the format.
_MAIN, _RELS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SUFFIXES = (".xlsx", ".xlsm")


def _column(reference: str) -> int:
    """The number, from 0, of a column in a cell's name such as AB12."""
    at = 0
    for ch in reference:
        if not ch.isalpha():
            break
        at = 26 * at + ord(ch.upper()) - 64
    return at - 1


def _texts(item) -> str:
    """The text of a string item, without the phonetic hints that may stand beside it."""
    return "".join(t.text or "" for part in item if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in part.iter(f"{_MAIN}t"))


def _active_sheet(book: zipfile.ZipFile) -> str:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheets = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    at = int(view.get("activeTab", "0")) if view is not None else 0
    wanted = sheets[at if at < len(sheets) else 0].get(f"{_RELS}id")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)


#: Fixed: numbers of the formats for dates and times that every workbook has.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def _shown_as_date(code: str) -> bool:
    """Whether a format's code has parts of a date or time, outside quotes, brackets and escapes."""
    return re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|General', "", code, flags=re.IGNORECASE), re.IGNORECASE) is not None


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """The styles of cells that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if _shown_as_date(f.get("formatCode") or "")}
    styles = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId") or 0) in DATE_FORMATS | own}


def as_date(days: str, since_1904: bool = False) -> str:
    """A number of days as date and time, to the second; as it stands if it is no such number."""
    try:
        start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
        return str(start + timedelta(seconds=round(float(days) * 86400)))
    except (ValueError, OverflowError):
        return days


def _since_1904(book: zipfile.ZipFile) -> bool:
    told = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
    return told is not None and told.get("date1904") in ("1", "true")


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The rows of the active sheet from its first to its last, empty ones between them included; a cell without a value is an empty text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        dates, late, expected = date_styles(book), _since_1904(book), 1
        with book.open(_active_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", expected))
                yield from ([] for _ in range(expected, number))
                expected, cells = number + 1, []
                for cell in row.findall(f"{_MAIN}c"):
                    place = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [""] * (place + 1 - len(cells))
                    value, inline = cell.find(f"{_MAIN}v"), cell.find(f"{_MAIN}is")
                    text = _texts(inline) if inline is not None else value.text or "" if value is not None else ""
                    kind = cell.get("t") or "n"
                    is_date = kind == "n" and text and int(cell.get("s") or 0) in dates
                    cells[place] = shared[int(text)] if kind == "s" and text else as_date(text, late) if is_date else text
                yield cells
                row.clear()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_file", pa.string()), ("_n", pa.int64()), ("_c", pa.list_(pa.string()))])
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = []
            for n, cells in enumerate(sheet_rows(content.as_py())):
                held.append({"_file": name, "_n": n, "_c": cells})
                if len(held) == 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """``_file, _n, _c``: file, number of the row from 0, and its cells, of one workbook or a folder of them."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), "content").mapInArrow(_read, "_file string, _n long, _c array<string>")
