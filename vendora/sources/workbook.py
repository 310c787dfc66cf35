"""Workbooks (xlsx): all sheets or one, in order, without all-empty rows.

An xlsx file is a zip archive of XML: the sheets in their order, shared strings, styles, and
the cells.  Files come as Spark's binary records, and a task parses one by pulling rows
from its compressed parts, so besides the archive and its shared strings it holds
ROWS rows at a time, however many a sheet has.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a batch.
ROWS = 5_000
#: Fixed values of the format: numbers of built-in date and time formats.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_SCHEMA = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
_ERRORS = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, TypeError)


def _column(reference: str) -> int:
    """Number of a cell's column from its reference, A1 being 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def is_date_format(code: str) -> bool:
    """Whether a number format shows dates or times: it has their letters outside of quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.', "", code.lower().split(";")[0])
    return bool(re.search("[ymdhs]", bare)) and "general" not in bare


def date_text(serial: float, from_1904: bool = False) -> str:
    """A serial number as a date and time, or as a time of day below 1; the leap day that 1900 didn't have is taken out."""
    micros = round(serial * 86_400_000) * 1000
    if 0 <= serial < 1:
        return str((datetime.datetime.min + datetime.timedelta(microseconds=micros)).time())
    first = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31) if serial < 60 else datetime.datetime(1899, 12, 30)
    return str(first + datetime.timedelta(microseconds=micros))


class Book:
    """An open archive: names and paths of its sheets, shared strings, and the styles that show dates."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.archive.namelist())
        self.shared: list[str] = []
        self.dates: set[int] = set()
        if "xl/sharedStrings.xml" in names:
            self.shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in self._pull("xl/sharedStrings.xml", "si")]
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.archive.read("xl/styles.xml"))
            own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter(f"{_MAIN}numFmt")}
            used = [int(x.get("numFmtId", 0)) for xfs in styles.iter(f"{_MAIN}cellXfs") for x in xfs.iter(f"{_MAIN}xf")]
            self.dates = {i for i, n in enumerate(used) if (is_date_format(own[n]) if n in own else n in DATE_FORMATS)}
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(self.archive.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.archive.read("xl/workbook.xml"))
        self.from_1904 = any(x.get("date1904") in ("1", "true") for x in book.iter(f"{_MAIN}workbookPr"))
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
        self.sheets = [(x.get("name"), place(targets[x.get(f"{_REL}id")])) for x in book.iter(f"{_MAIN}sheet")]

    def _pull(self, part: str, tag: str) -> Iterator[ElementTree.Element]:
        """Elements of a part, one after another; what has been read is forgotten."""
        with self.archive.open(part) as stream:
            open_: list[ElementTree.Element] = []
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    open_.append(element)
                    continue
                open_.pop()
                if element.tag == _MAIN + tag:
                    yield element
                    if open_:
                        open_[-1].remove(element)

    def rows(self, part: str) -> Iterator[list[str | None]]:
        """Cells of each row of a sheet that the file has."""
        for row in self._pull(part, "row"):
            cells: list[str | None] = []
            for cell in row:
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self._value(cell)
            yield cells

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.shared[int(value.text)]
        if kind == "b":
            return {"1": "True", "0": "False"}.get(value.text, value.text)
        if kind == "d":
            return value.text.replace("T", " ")
        if kind in (None, "n") and int(cell.get("s", 0)) in self.dates:
            return date_text(float(value.text), self.from_1904)
        return None if kind == "e" else value.text


def header_names(cells: list[str | None]) -> list[str]:
    """Names of columns: a blank one by its place, and of repeated ones all but the first with a number."""
    out: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = plain = f"Unnamed: {i}" if cell in (None, "") else cell
        number = 0
        while name in taken:
            number += 1
            name = f"{plain}.{number}"
        taken.add(name)
        out.append(name)
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """rows_of the workbooks at a path."""
    return rows_of(_files(spark, path), sheet)


def rows_of(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """path, sheet, sheet_no, row, cells (map) of every row of files (path, content) that isn't empty.

    Numbers are their text in the file, cells with a date format are ``2024-01-31 00:00:00``, booleans
    True and False, errors empty.  A header that comes again gets a number (``Nome.1``); a cell
    beyond the header is named by its place.  A file that can't be read gives a row
    with the cell erro_processamento_excel.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, content in zip(files.column(0).to_pylist(), files.column(1), strict=True):
                held: list[tuple] = []
                try:
                    book = Book(content.as_py())
                    for number, (title, part) in enumerate(book.sheets):
                        if sheet not in (None, title):
                            continue
                        header: list[str] | None = None
                        for i, cells in enumerate(book.rows(part), -1):
                            if header is None:
                                header = header_names(cells)
                                continue
                            header += [f"Unnamed: {k}" for k in range(len(header), len(cells))]
                            pairs = [(h, c) for h, c in zip(header, cells, strict=False) if c not in (None, "")]
                            if pairs:
                                held.append((name, title, number, i, pairs))
                            if len(held) >= ROWS:
                                yield batch(held)
                                held = []
                except _ERRORS as e:
                    held.append((name, None, None, 0, [("erro_processamento_excel", str(e))]))
                yield batch(held)

    return files.select("path", "content").mapInArrow(read, "path string, sheet string, sheet_no int, row bigint, cells map<string,string>")


def headers_of(spark: SparkSession, path: str, sheet: str | None = None, first_only: bool = False) -> list[str]:
    """Headers of all sheets, or one, in the order of their columns; only each sheet's first row is parsed."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            found: list[tuple[str, int]] = []
            for content in files.column(1):
                try:
                    book = Book(content.as_py())
                    for title, part in book.sheets[:1] if first_only else book.sheets:
                        if sheet in (None, title):
                            found += [(n, at) for at, n in enumerate(header_names(next(book.rows(part), [])))]
                except _ERRORS:
                    found.append(("erro_processamento_excel", 1 << 30))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], ["name", "at"])

    names = _files(spark, path).mapInArrow(read, "name string, at int").groupBy("name").agg(F.min("at").alias("at"))
    return [r.name for r in names.orderBy("at", "name").collect()]
