"""Record sinks on files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from reqweave.functions.jsonvals import escape_markup, pretty_record
from reqweave.operators.merge import stringify
from reqweave.operators.ordering import parts_in_group

#: A document has so many rows at most, and about so many bytes (a longer row stays whole).
DOCUMENT_ROWS, DOCUMENT_BYTES = 10_000, 64 << 20


def sink_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Header and cell texts, quoted where needed, blanks kept."""
    stringify(df).write.mode(mode).options(
        header=True, sep=delimiter, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def sink_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    sink_csv(df, path, "\t", mode)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, keys sorted, nulls kept."""
    record = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.select(escape_markup(F.to_json(record, {"ignoreNullFields": "false"})).alias("value"))


def sink_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_lines(df).write.mode(mode).text(path)


def safe_names(df: DataFrame) -> DataFrame:
    """Columns renamed to valid XML element names; names that become equal are numbered."""

    def safe(name: str) -> str:
        out = re.sub(r"[^A-Za-z0-9_.-]", "_", name) or "_"
        return re.sub(r"^[0-9.-]", "_", out)

    names: list[str] = []
    taken = {c.lower() for c in df.columns if safe(c) == c}
    for column in df.columns:
        name, k = safe(column), 1
        while name != column and name.lower() in taken:
            k += 1
            name = f"{safe(column)}_{k}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def sink_xml(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``<records><record>..``; null fields are left out."""
    # no column is an attribute, whatever its name starts with
    safe_names(df).write.mode(mode).format("xml").options(
        rootTag="records", rowTag="record", attributePrefix="@", valueTag="#text"
    ).save(path)


def json_documents(
    df: DataFrame, group: str, order_by: list[str], rows_per_document: int = DOCUMENT_ROWS, columns: list[str] | None = None,
    bytes_per_document: int = DOCUMENT_BYTES,
) -> DataFrame:
    """Indented JSON arrays ``(group, part, rows, document)`` of the ``columns`` (all by default).

    A group becomes as many documents as its size asks for, so a group that holds a
    third of the table is still written by many tasks, whole and in order, and a document of long rows has fewer of them.
    """
    columns = columns or df.columns
    item = F.concat(F.lit("  "), F.replace(pretty_record(df, columns), F.lit("\n"), F.lit("\n  ")))
    shown = df.withColumn("_item", item)
    placed = parts_in_group(shown, group, order_by, F.octet_length("_item") + 2, bytes_per_document, rows_per_document)
    parts = placed.select(F.col(group), F.col("_part").alias("part"), "_group_idx", "_item")
    listed = F.array_sort(F.collect_list(F.struct("_group_idx", "_item")))
    text = F.array_join(F.transform(listed, lambda r: r["_item"]), ",\n")
    return parts.groupBy(group, "part").agg(
        F.count("*").alias("rows"), F.concat(F.lit("[\n"), text, F.lit("\n]\n")).alias("document")
    )


def sink_json(
    df: DataFrame, path: str, group: str, order_by: list[str], rows_per_document: int = DOCUMENT_ROWS, mode: str = "errorifexists",
    columns: list[str] | None = None, bytes_per_document: int = DOCUMENT_BYTES,
) -> None:
    """One file per document, in folders named after group and part."""
    documents = json_documents(df, group, order_by, rows_per_document, columns, bytes_per_document)
    documents.select(group, "part", "document").write.mode(mode).partitionBy(group, "part").option("lineSep", "\n").text(path)


def run_scoped_path(path: str, run_id: int) -> str:
    """``out.ext`` to ``out.job-<id>.ext``; an older suffix is replaced."""
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    if not dot:
        stem, ext = name, ""
    stem = re.sub(r"\.job-\d+$", "", stem)
    return (folder + "/" if folder or path.startswith("/") else "") + f"{stem}.job-{run_id}{dot}{ext}"


def export_convert(spark, source: str, target: str, format: str, **options) -> None:
    """Stored JSON lines to another format, columns sorted."""
    rows = spark.read.json(source)
    rows = rows.select(*sorted(rows.columns))
    writers = {"jsonl": sink_jsonl, "csv": sink_csv, "tsv": sink_tsv, "xml": sink_xml, "json": sink_json}
    if format == "xlsx":
        from reqweave.sinks.workbooks import sink_xlsx

        return sink_xlsx(rows, target, **options)
    if format not in writers:
        raise ValueError(f"unsupported export format {format!r}")
    writers[format](rows, target, **options)
