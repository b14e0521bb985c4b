"""A folder of XLSX workbooks; one workbook is one row of work."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CELLS = "path string, row_no long, cells map<string,string>"
# Names inside a workbook.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _all_text(node) -> str:
    text = "".join(t.text or "" for t in node.iter(MAIN + "t"))
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _active_sheet(book: zipfile.ZipFile) -> str:
    root = ET.fromstring(book.read("xl/workbook.xml"))
    view = root.find(f"{MAIN}bookViews/{MAIN}workbookView")
    active = int(view.get("activeTab", "0")) if view is not None else 0
    sheets = root.findall(f"{MAIN}sheets/{MAIN}sheet")
    wanted = sheets[min(active, len(sheets) - 1)].get(RELATION)
    for link in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == wanted:
            return "xl/" + link.get("Target").removeprefix("/xl/")
    raise ValueError("workbook without sheets")


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Cell texts of the active sheet, row by row; gaps are empty text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_all_text(s) for s in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        with book.open(_active_sheet(book)) as sheet:
            for _, node in ET.iterparse(sheet):
                if node.tag != MAIN + "row":
                    continue
                row: list[str] = []
                for cell in node.iter(MAIN + "c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(row)
                    value = cell.find(MAIN + "v")
                    kind = cell.get("t")
                    text = _all_text(cell) if kind == "inlineStr" else (value.text or "" if value is not None else "")
                    if kind == "s" and value is not None:
                        text = shared[int(text)]
                    elif kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    row.extend([""] * (at - len(row)))
                    row.append(text)
                yield row
                node.clear()


def named_rows(content: bytes, has_header: bool) -> list[tuple[int, dict]]:
    """(row number, cells by header); blank rows skipped, wider rows get col_N."""
    rows = [r for r in sheet_rows(content) if any(r)]
    if not rows:
        return []
    names = list(rows.pop(0)) if has_header else []
    width = max([len(r) for r in rows] + [len(names)])
    names += [f"col_{i + 1}" for i in range(len(names), width)]
    return [(i, dict(zip(names, r + [""] * (width - len(r))))) for i, r in enumerate(rows)]


def read_workbooks(books: DataFrame, has_header: bool = True) -> DataFrame:
    """``books(path, content)`` to one row per sheet row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = named_rows(bytes(content), has_header)
                yield pd.DataFrame([(path, i, cells) for i, cells in found], columns=["path", "row_no", "cells"])

    return books.select("path", "content").mapInPandas(parse, CELLS)


def scan_xlsx(spark: SparkSession, folder: str, has_header: bool = True) -> DataFrame:
    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    return read_workbooks(books, has_header)


def workbook_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Cells as columns; a header missing in one workbook reads as empty text."""
    return rows.select("path", "row_no", *[F.coalesce(F.col("cells")[n], F.lit("")).alias(n) for n in names])


def workbook_records(spark: SparkSession, folder: str, has_header: bool = True) -> DataFrame:
    """Records of a folder of workbooks: ``path, row_no`` and one text column per header name.

    The names are the union over all workbooks, by their first place in a sheet, then by name.
    """
    rows = scan_xlsx(spark, folder, has_header)
    places = rows.select(F.posexplode(F.map_keys("cells")).alias("place", "name")).groupBy("name").agg(F.min("place").alias("place"))
    return workbook_columns(rows, [r["name"] for r in places.orderBy("place", "name").collect()])
