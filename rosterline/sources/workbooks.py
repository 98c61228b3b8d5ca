"""Excel workbooks in bulk: one task per file, every cell as text.

A sheet holds at most 1,048,576 rows, which bounds what one task reads or writes at a time.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterline.operators.headers import number_repeats

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS = 10_000
# The row limit of a sheet and the name of the sheet in an export.
SHEET_ROWS = 1_048_576
EXPORT_SHEET = "Ops-Data"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

# How the format writes a character by its code, and the characters that XML cannot hold.
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
NOT_IN_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")

Row = list[str | None]


def _text(element: ElementTree.Element) -> str:
    """Text of a string item, without its reading aids."""
    runs = [element, *element.findall(f"{MAIN}r")]
    text = "".join(t.text or "" for run in runs for t in run.findall(f"{MAIN}t"))
    return ESCAPED.sub(lambda found: chr(int(found[1], 16)), text)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_text(item) for _, item in ElementTree.iterparse(part) if item.tag == f"{MAIN}si"]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for style in root.iter(f"{MAIN}numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", style.get("formatCode", ""))
        if re.search(r"[dmyhs]", bare, re.IGNORECASE):
            dates.add(int(style.get("numFmtId", "0")))
    cell_styles = root.find(f"{MAIN}cellXfs")
    return {i for i, xf in enumerate(cell_styles if cell_styles is not None else []) if int(xf.get("numFmtId", "0")) in dates}


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """Part name of the first sheet, and whether its dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    settings = root.find(f"{MAIN}workbookPr")
    from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
    link = root.find(f"{MAIN}sheets/{MAIN}sheet").get(LINK)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(each.get("Target") for each in links if each.get("Id") == link)
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), from_1904


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference:
        if not letter.isalpha():
            break
        index = index * 26 + ord(letter.upper()) - ord("A") + 1
    return index - 1


def _number_text(text: str, is_date: bool, from_1904: bool) -> str:
    value = float(text)
    if is_date:
        start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
        return str(start + dt.timedelta(milliseconds=round(value * 86_400_000)))
    return str(int(value)) if value.is_integer() else str(value)


def sheet_rows(content: bytes) -> Iterator[tuple[int, Row]]:
    """Row number from 0 and cell texts of the first sheet, without the blank rows at its end."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        part, from_1904 = _first_sheet(book)

        def cell_text(cell: ElementTree.Element) -> str | None:
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                inline = cell.find(f"{MAIN}is")
                return None if inline is None else _text(inline)
            value = cell.findtext(f"{MAIN}v")
            if value is None or kind == "e":
                return None
            if kind == "s":
                return strings[int(value)]
            if kind == "b":
                return str(value == "1")
            return _number_text(value, int(cell.get("s", "0")) in dates, from_1904) if kind == "n" else value

        with book.open(part) as sheet:
            following = 0
            for _, element in ElementTree.iterparse(sheet):
                if element.tag != f"{MAIN}row":
                    continue
                number = int(element.get("r", following + 1)) - 1
                values: Row = []
                for cell in element.findall(f"{MAIN}c"):
                    at = _column_index(cell.get("r", "")) if cell.get("r") else len(values)
                    values.extend([None] * (at - len(values)))
                    values.append(cell_text(cell) or None)
                element.clear()
                if any(value is not None for value in values):
                    for blank in range(following, number):
                        yield blank, []
                    yield number, values
                    following = number + 1


def _parse(header_only: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple[str, int, Row]] = []
                for number, values in sheet_rows(content):
                    rows.append((path, number, values))
                    if header_only or len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=["file", "row", "values"])
                        rows = []
                    if header_only:
                        break
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "row", "values"])

    return parse


def workbook_rows(files: DataFrame, header_only: bool = False) -> DataFrame:
    """Rows of the workbooks in a frame with ``path`` and ``content``."""
    return files.select("path", "content").mapInPandas(_parse(header_only), "file string, row int, values array<string>")


def workbook_cells(files: DataFrame) -> DataFrame:
    """One row per non-empty cell."""
    cells = workbook_rows(files).select("file", "row", F.posexplode("values").alias("col", "value"))
    return cells.filter(F.col("value").isNotNull())


def workbook_wide(files: DataFrame) -> DataFrame:
    """The workbooks as one table, with the first row of each as its header.

    The driver sees the header and the width of the widest row; cells right of the header are kept, in columns
    that are named by their place. Repeated headers are numbered. All files must have the same header.
    """
    headers = workbook_rows(files, header_only=True).filter("row = 0").select("values").distinct().take(2)
    if len(headers) != 1:
        raise ValueError("no header row found" if not headers else "the workbooks have different headers")
    rows = workbook_rows(files)
    widest = rows.agg(F.max(F.size("values"))).first()[0] or 0
    cells = [*headers[0]["values"], *[None] * (widest - len(headers[0]["values"]))]
    names = number_repeats([name or f"Unnamed: {i}" for i, name in enumerate(cells)])

    def cell(i: int, name: str) -> Column:
        return F.get(F.col("values"), F.lit(i)).alias(name)

    return rows.filter("row > 0").select(*[cell(i, name) for i, name in enumerate(names)])


def _files(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob)


def read_workbooks(spark: SparkSession, glob: str) -> DataFrame:
    """Cells (file, row, col, value) of the first sheet of every workbook that matches."""
    return workbook_cells(_files(spark, glob))


def workbook_table(spark: SparkSession, glob: str) -> DataFrame:
    return workbook_wide(_files(spark, glob))


# The parts of a workbook that do not depend on its rows.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="xl/workbook.xml" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    f'<sheet name="{EXPORT_SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
}
SHEET_OPEN = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
SHEET_CLOSE = "</sheetData></worksheet>"
CARRIAGE_RETURN = {"\r": "&#13;"}


class _Writer:
    """One workbook in memory, written row by row."""

    def __init__(self, header: list[str]):
        self.buffer, self.rows = io.BytesIO(), 0
        self.book = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_DEFLATED)
        for name, text in PARTS.items():
            self.book.writestr(name, text)
        self.sheet = self.book.open("xl/worksheets/sheet1.xml", "w")
        self.sheet.write(SHEET_OPEN.encode())
        self.add(header)

    def add(self, values) -> None:
        def cell(value: str | None) -> str:
            if value is None:
                return "<c/>"
            text = escape(NOT_IN_XML.sub(lambda found: f"_x{ord(found[0]):04X}_", value), CARRIAGE_RETURN)
            return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

        cells = "".join(cell(value) for value in values)
        self.sheet.write(f"<row>{cells}</row>".encode())
        self.rows += 1

    def content(self) -> bytes:
        self.sheet.write(SHEET_CLOSE.encode())
        self.sheet.close()
        self.book.close()
        return self.buffer.getvalue()


def to_workbooks(df: DataFrame, name: str, sheet_rows: int = SHEET_ROWS) -> DataFrame:
    """The rows as workbook files (path, content): at least one per partition with rows, more where a sheet is full."""
    header = df.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, writer = TaskContext.get().partitionId(), 0, None

        def finished() -> pd.DataFrame:
            return pd.DataFrame({"path": [f"{name}-{part:05d}-{count:03d}.xlsx"], "content": [writer.content()]})

        for batch in batches:
            texts = batch.astype(object).where(batch.notna(), None)
            for values in texts.itertuples(index=False, name=None):
                if writer is not None and writer.rows >= sheet_rows:
                    yield finished()
                    writer, count = None, count + 1
                writer = writer or _Writer(header)
                writer.add(values)
        if writer is not None:
            yield finished()

    text = df.select(*[F.col("`" + column.replace("`", "``") + "`").cast("string").alias(column) for column in header])
    return text.mapInPandas(pack, "path string, content binary")


def empty_workbook(spark: SparkSession, header: list[str], name: str) -> DataFrame:
    """A workbook file with nothing but the header."""
    return spark.createDataFrame([(f"{name}.xlsx", _Writer(header).content())], "path string, content binary")


def save_workbooks(files: DataFrame, folder: str) -> int:
    """Write workbook files to a folder, given as a URI, that all executors share; returns how many.

    Each file gets its name when it is complete, so a task that is run again replaces it whole.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                unfinished = f"{root}/_{uuid.uuid4().hex}"
                with place.open_output_stream(unfinished) as out:
                    out.write(content)
                place.move(unfinished, f"{root}/{path}")
            yield pd.DataFrame({"saved": [len(batch)]})

    return files.select("path", "content").mapInPandas(save, "saved long").agg(F.sum("saved")).head()[0] or 0
