"""Record sources on files. Text formats give text columns; nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reqweave.functions.binding import let
from reqweave.functions.jsonvals import object_fields, strict_value
from reqweave.functions.text import is_blank, trim_space
from reqweave.sources.arrays import columns_of, json_objects
from reqweave.sources.blocks import BLOCK, BOM, PLACE, SOURCE, with_folders
from reqweave.sources.records import scan_csv_placed

# Delimiter candidates in order of preference. What sniffing looks at is a parameter; a given separator avoids it.
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_CHARS = 8192
SNIFF_LINES = 10
HEAD_CHARS = 512


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def sniff_delimiter(text: Column, chars: int = SNIFF_CHARS, most_lines: int = SNIFF_LINES) -> Column:
    """Most likely separator of CSV text: counts in the first line, more if every line agrees."""
    head = F.regexp_replace(F.left(text, F.lit(chars)), "^" + BOM, "")
    lines = F.slice(F.filter(F.split(head, "\r?\n"), lambda s: trim_space(s) != ""), 1, most_lines)

    def ranked(rows: Column, rank: int, delimiter: str) -> Column:
        score = let(
            F.transform(rows, lambda s: _count(s, delimiter)),
            lambda n: F.when(F.get(n, F.lit(0)) > 0, F.get(n, F.lit(0)) * 10 + F.when(F.size(F.array_distinct(n)) == 1, 100).otherwise(0)),
        )
        return F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(delimiter).alias("delimiter"))

    def best(rows: Column) -> Column:
        scores = F.array(*[ranked(rows, i, d) for i, d in enumerate(DELIMITERS)])
        return F.array_max(F.filter(scores, lambda r: r["score"].isNotNull()))["delimiter"]

    return F.coalesce(let(lines, best), F.lit(DELIMITERS[0]))


def frequent_delimiter(text: Column) -> Column:
    """Separator that occurs most often, the preferred one among equals."""
    ranked = [
        F.struct(_count(text, d).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter"))
        for i, d in enumerate(DELIMITERS)
    ]
    return let(F.array_max(F.array(*ranked)), lambda b: F.when(b["n"] > 0, b["delimiter"]).otherwise(DELIMITERS[0]))


def detect_format(path: Column, content: Column, chars: int = HEAD_CHARS) -> Column:
    """struct(type, delimiter, has_header) by extension, then by the first characters."""
    head = F.left(content, F.lit(chars))
    seen = F.struct(
        head.alias("head"), F.left(trim_space(head), F.lit(1)).alias("start"),
        F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).alias("ext"),
    )

    def kind_of(s: Column) -> Column:
        return (
            F.when(s["ext"] == ".xlsx", "xlsx")
            .when((s["ext"] == ".json") & (s["start"] == "["), "json")
            .when(s["ext"].isin(".json", ".jsonl"), "jsonl")
            .when(s["ext"] == ".xml", "xml")
            .when(s["start"] == "<", "xml")
            .when(s["start"] == "[", "json")
            .when(s["start"] == "{", "jsonl")
            .otherwise("csv")
        )

    def described(s: Column, kind: Column) -> Column:
        return F.struct(
            kind.alias("type"), F.when(kind == "csv", frequent_delimiter(s["head"])).alias("delimiter"),
            kind.isin("csv", "xlsx").alias("has_header"),
        )

    return let(seen, lambda s: let(kind_of(s), lambda kind: described(s, kind)))


def file_inventory(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Data files with size and time; contents are never read."""
    files = spark.read.format("binaryFile").load(folders)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select(
        name.alias("name"), folder.alias("dir"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mod_time"), "path",
    )


def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Format and separator of every file of a folder of small files."""
    files = spark.read.format("binaryFile").load(folder)
    text = F.decode(F.substring("content", 1, SNIFF_CHARS), "UTF-8")
    found = files.select("path", text.alias("_text"))
    return found.select("path", detect_format(F.col("path"), F.col("_text")).alias("f"), sniff_delimiter(F.col("_text")).alias("sniffed")).select(
        "path", "f.type", "f.delimiter", "f.has_header", "sniffed"
    )


def head_delimiter(spark: SparkSession, path: str) -> str:
    """Separator of a CSV path by its first non-blank lines (a bounded read)."""
    lines = spark.read.text(path).where(~is_blank(F.col("value"))).limit(SNIFF_LINES)
    text = lines.agg(F.array_join(F.collect_list("value"), "\n").alias("t"))
    return text.select(sniff_delimiter(F.col("t"))).first()[0]


def scan_csv(
    spark: SparkSession, path: str, delimiter: str = "", has_header: bool = True, columns: list[str] | None = None, placed: bool = False,
) -> DataFrame:
    """CSV with text columns; missing and empty cells are empty text.

    Cells may hold line breaks in quotes, and big files are read by many tasks all the same (see ``records``). With
    ``placed`` the columns ``_src, _block, _place`` tell where each record stands.
    """
    found = scan_csv_placed(spark, path, delimiter or head_delimiter(spark, path), has_header, columns)
    found = with_folders(spark, path, found)
    return found if placed else found.drop(SOURCE, BLOCK, PLACE)


def scan_json(spark: SparkSession, path: str, root_path: str = "", schema: T.StructType | str | None = None, placed: bool = False) -> DataFrame:
    """A top-level array or object per file, or what lies at ``root_path``; big files are cut over many tasks.

    ``schema`` is that of the top-level objects. Without one the common type of all records is taken from a copy of
    their texts. With ``placed`` the columns ``_src, _block, _place`` tell where each record stands.
    """
    steps = path_steps(root_path)
    texts, followed = json_objects(spark, path, steps)
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if followed and known is not None:
        known = element_type(known, steps)
    df = columns_of(texts, known)
    if steps and not followed:
        df = select_root(df, root_path, [SOURCE, BLOCK, PLACE])
    if not steps:
        df = with_folders(spark, path, df, known)
    return df if placed else df.drop(SOURCE, BLOCK, PLACE)


def path_steps(root_path: str) -> list[str]:
    where = root_path.strip().removeprefix("$.").removeprefix(".").strip("/")
    return [s for s in re.split("[./]", where) if s and s != "$"]


def element_type(schema: T.StructType, steps: list[str]) -> T.StructType:
    """Type of the elements of the array at ``steps``."""
    now: T.DataType = schema
    for step in steps:
        now = now[step].dataType
    if not isinstance(now, T.ArrayType) or not isinstance(now.elementType, T.StructType):
        raise ValueError(f"the schema has no array of objects at {'.'.join(steps)}")
    return now.elementType


def select_root(df: DataFrame, root_path: str, keep: list[str] | None = None) -> DataFrame:
    """Descend by object members; an array gives many rows, an object one. Columns of ``keep`` are repeated."""
    steps, keep = path_steps(root_path), keep or []
    if not steps:
        return df
    target = F.col(".".join(f"`{s}`" for s in steps))
    chosen = df.select(*keep, target.alias("_root"))
    kind = chosen.schema["_root"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return chosen.select(*keep, F.inline("_root"))
    if isinstance(kind, T.StructType):
        return chosen.select(*keep, "_root.*")
    raise ValueError(f"json root_path {root_path!r} is not an object or array of objects")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; blank lines are skipped, a bad line fails the read.

    Without a schema the lines are copied while they are read, and the common type of all records is taken from the copy.
    """
    if schema is not None:
        return spark.read.option("mode", "FAILFAST").schema(schema).json(path)
    lines = spark.read.text(path)
    return columns_of(lines.where(~is_blank(F.col("value"))))


def scan_xml(spark: SparkSession, path: str, record_path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Every element named ``record_path``; attributes as ``@name``, mixed text as ``#text``."""
    if not record_path:
        raise ValueError("record_path is required")
    reader = spark.read.format("xml").options(
        rowTag=record_path, attributePrefix="@", valueTag="#text", inferSchema=False, mode="FAILFAST"
    )
    return (reader.schema(schema) if schema is not None else reader).load(path)


def tolerant_preview(spark: SparkSession, path: str, n: int = 50, delimiter: str = "") -> DataFrame:
    """First ``n`` records of a JSONL, CSV or TSV file for looking at; bad JSON lines are skipped.

    Cells may hold quoted line breaks; a separator that is not given is guessed.
    """
    if path.endswith((".csv", ".tsv")):
        return scan_csv(spark, path, delimiter, placed=True).orderBy(SOURCE, BLOCK, PLACE).drop(SOURCE, BLOCK, PLACE).limit(n)
    return readable_lines(spark.read.text(path)).limit(n)


def readable_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that hold one JSON object each, as a member map."""
    return lines.select(object_fields(strict_value(F.col(column))).alias("record")).where(F.col("record").isNotNull())
