"""Scans of xlsx workbooks and CSV files by their header texts.

A workbook is a ZIP archive of XML parts. Spark reads the files and deals them out to
tasks; each task streams the wanted sheet of one file after the other, so it holds a file,
its shared strings and a batch of rows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.sinks import named

_BATCH = 1000


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    """The text of a string item: its runs joined, without reading aids."""
    if _local(element) == "rPh":
        return ""
    own = element.text or "" if _local(element) == "t" else ""
    return own + "".join(_text(child) for child in element)


def _column(reference: str) -> int:
    """A cell's column from 0, of a reference like AB12."""
    at = 0
    for letter in re.match("[A-Z]+", reference.upper()).group():
        at = at * 26 + ord(letter) - 64
    return at - 1


def _header(text: str) -> str:
    return " ".join(text.split()).lower()


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str:
    """Where the named sheet's rows are, or the first sheet's without a name."""
    found = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]
    wanted = [e for e in found if sheet is None or e.get("name") == sheet]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r}; there are {[e.get('name') for e in found]}")
    relation = next(v for k, v in wanted[0].items() if k.endswith("}id"))
    parts = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return posixpath.normpath(posixpath.join("/xl", parts[relation])).lstrip("/")


def _cell(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(e) for e in cell if _local(e) == "is")
    value = next((e.text for e in cell if _local(e) == "v"), None)
    if value is None or kind == "e":
        return None
    return shared[int(value)] if kind == "s" else {"1": "true", "0": "false"}[value] if kind == "b" else value


def _rows(content: bytes, sheet: str | None) -> Iterator[tuple[int, dict[int, str]]]:
    """Each row's number from 1, and its cells that are not empty by column."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(e) == "si"]
        with book.open(_sheet_part(book, sheet)) as part:
            number, data = 0, None
            for event, element in ElementTree.iterparse(part, ("start", "end")):
                if event == "start" and _local(element) == "sheetData":
                    data = element
                if event == "start" or _local(element) != "row":
                    continue
                number, at, cells = int(element.get("r", number + 1)), -1, {}
                for cell in element:
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    if (value := _cell(cell, shared)) is not None and value.strip():
                        cells[at] = value.strip()
                data.clear()
                yield number, cells


def sheet_cells(spark: SparkSession, paths: str | list[str], sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """(path, row, cells) of the rows below the header; cells maps header texts to values.

    Headers are lower-cased with single blanks; of equal ones the first counts. Values are
    text as stored (dates are day numbers, see `serial_date`), blanks around them are cut and
    empty cells and errors have no entry. Rows without any value have no row here. A missing
    sheet is a ValueError.
    """

    def scan(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, held = {}, []
                for number, cells in _rows(content.as_py(), sheet):
                    if number == header_row:
                        first = {_header(cells[at]): at for at in sorted(cells, reverse=True)}
                        names = {at: name for name, at in first.items()}
                    elif number > header_row and cells:
                        held.append((path, number, [(names[at], value) for at, value in cells.items() if at in names]))
                    if len(held) >= _BATCH:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(scan, "path string, row int, cells map<string,string>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "row", "cells"])


def sheet_rows(spark: SparkSession, paths: str | list[str], headers: dict[str, str], sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """(path, row, a text column for each of `headers`); a header that is missing gives nulls."""
    cells = sheet_cells(spark, paths, sheet, header_row)
    return cells.select("path", "row", *[F.col("cells")[_header(h)].alias(c) for h, c in headers.items()])


def upload_rows(spark: SparkSession, path: str, headers: dict[str, str], sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """The named columns of an uploaded CSV or xlsx file; a ValueError for other kinds."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        return sheet_rows(spark, path, headers, sheet, header_row).select(*headers.values())
    if kind == "csv":
        return named(spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True), headers)
    raise ValueError(f"uploads are csv or xlsx files, not {path!r}")


def serial_date(value: Column) -> Column:
    """The date of a workbook's day number; null for other text."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value.try_cast("double")).cast("int"))
