"""XLSX workbooks, one per group and part."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqweave.operators.merge import stringify
from reqweave.operators.ordering import parts_in_group

#: A workbook has so many rows at most, and about so many bytes before it is packed (a longer row stays whole).
BOOK_ROWS, BOOK_BYTES = 100_000, 64 << 20
#: Markup around a cell.
CELL_BYTES = 60
BOOKS = "group string, part long, rows long, content binary"
# The parts every workbook consists of.
SHEET_NAME = "Output"
_NS = "http://schemas.openxmlformats.org"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_TYPES = (
    f'{_XML}<Types xmlns="{_NS}/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    "</Types>"
)
_ROOT = (
    f'{_XML}<Relationships xmlns="{_NS}/package/2006/relationships">'
    f'<Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
)
_BOOK = (
    f'{_XML}<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships">'
    f'<sheets><sheet name="{SHEET_NAME}" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_BOOK_LINKS = (
    f'{_XML}<Relationships xmlns="{_NS}/package/2006/relationships">'
    f'<Relationship Id="rId1" Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
)


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


# Fixed value: the most characters a cell may hold.
CELL_CHARS = 32_767
# characters XML cannot hold or would change, and text that looks like their escape
_ESCAPED = re.compile("_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ufffe\uffff]")


def _cell(column: int, row: int, text: str) -> str:
    if len(text) > CELL_CHARS:
        raise ValueError(f"a workbook cell holds {CELL_CHARS} characters at most, column {column + 1} has {len(text)}")
    kept = _ESCAPED.sub(lambda m: f"_x{ord(m.group()):04X}_", text)
    return f'<c r="{_letters(column)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(kept)}</t></is></c>'


def workbook_bytes(header: list[str], rows: list[list[str]]) -> bytes:
    lines = []
    for i, row in enumerate([header, *rows], start=1):
        lines.append(f'<row r="{i}">' + "".join(_cell(j, i, t) for j, t in enumerate(row) if t != "") + "</row>")
    sheet = f'{_XML}<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in [
            ("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("xl/workbook.xml", _BOOK),
            ("xl/_rels/workbook.xml.rels", _BOOK_LINKS), ("xl/worksheets/sheet1.xml", sheet),
        ]:
            book.writestr(name, text)
    return out.getvalue()


def _row_bytes(df: DataFrame, names: list[str]) -> Column:
    """About what a row takes in its sheet before it is packed."""
    texts = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in names]
    return F.lit(0) + sum((F.octet_length(t) + CELL_BYTES for t in texts), F.lit(0))


def build_workbooks(
    df: DataFrame, group: str, order_by: list[str], rows_per_book: int = BOOK_ROWS, columns: list[str] | None = None,
    bytes_per_book: int = BOOK_BYTES,
) -> DataFrame:
    """``(group, part, rows, content)`` of the ``columns`` (all by default); a big group becomes several bounded workbooks.

    A task holds one book at a time: its rows as text, and its content.
    """
    names = columns or df.columns
    placed = parts_in_group(df, group, order_by, _row_bytes(df, names), bytes_per_book, rows_per_book)
    cells = stringify(placed.select(*names)).columns
    keyed = placed.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"),
        "_part", "_group_idx", *names,
    )
    texts = stringify(keyed).withColumn("_part", F.col("_part").cast("long")).withColumn("_group_idx", F.col("_group_idx").cast("long"))

    def one_book(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("_group_idx")[cells]
        content = workbook_bytes(cells, ordered.values.tolist())
        return pd.DataFrame([(key[0], key[1], len(rows), content)], columns=["group", "part", "rows", "content"])

    return texts.groupBy("_g", "_part").applyInPandas(one_book, BOOKS)


def file_store(folder: str):
    """``(file system, path)`` of a folder given as a path or an address; every executor opens it for itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))


def qualified(spark: SparkSession, folder: str) -> str:
    """A path without a scheme as an address on the session's file system."""
    if "://" in folder:
        return folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    address = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + address.removeprefix("file:") if address.startswith("file:/") else address


def sink_xlsx(
    df: DataFrame, folder: str, group: str, order_by: list[str], rows_per_book: int = BOOK_ROWS, columns: list[str] | None = None,
    bytes_per_book: int = BOOK_BYTES,
) -> None:
    """Save the workbooks in a folder every executor can reach, on the file system that Spark takes the path for.

    Names depend on group and part only and files appear by renaming, so a task
    that runs twice replaces its own file by an equal one.
    """

    folder = qualified(df.sparkSession, folder)

    def save(books) -> None:
        store, top = file_store(folder)
        store.create_dir(top, recursive=True)
        for b in books:
            safe = "".join(ch if ch.isalnum() or ch in "-_." else "_" for ch in b["group"])
            target = f"{top}/{safe}-{b['part']:05d}.xlsx"
            partial = f"{top}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(partial) as out:
                out.write(b["content"])
            store.move(partial, target)

    build_workbooks(df, group, order_by, rows_per_book, columns, bytes_per_book).foreachPartition(save)
