"""CSV records that may hold line breaks, read by many tasks per file.

Lines are the pieces. A first pass reports per block how it ends if it begins outside or inside a quoted cell;
with the prefix of these reports the second pass joins lines to records. A record that runs over the edge of a block is
put together from its parts, of which a block has two at most.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqweave.sources.blocks import BLOCK, BOM, PLACE, SOURCE, pieces, runs, with_report, with_state
from reqweave.storage import materialize

#: Lines that are read at first, and then twice as many, to find the end of the header record.
HEAD_LINES = 100


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell. A quote opens at the start of a cell only; two quotes are one of the text."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            inside, at = False, line.find(sep, quote + 1) + len(sep)
            if at < len(sep):
                return False
        elif line.startswith('"', at):
            inside, at = True, at + 1
        else:
            opening = line.find(sep + '"', at)
            if opening < 0:
                return False
            inside, at = True, opening + len(sep) + 1


REPORT = f"{SOURCE} string, {BLOCK} long, out boolean, inside boolean, closes boolean"


def block_reports(lines: DataFrame, sep: str) -> DataFrame:
    """Per block: the state at its end for both states at its start, and whether some line ends outside if it begins inside."""
    schema = pa.schema([(SOURCE, pa.string()), (BLOCK, pa.int64()), ("out", pa.bool_()), ("inside", pa.bool_()), ("closes", pa.bool_())])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (False, True, False)

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((*key, *state), schema, strict=True)], schema=schema)

        for here, rows in runs(batches):
            if here != key:
                if key is not None:
                    yield done()
                key, state = here, (False, True, False)
            values = rows.column(2)
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                out = ends_inside(line, sep, state[0])
                inside = out if state[0] == state[1] else ends_inside(line, sep, state[1])
                state = out, inside, state[2] or not inside
        if key is not None:
            yield done()

    return lines.select(SOURCE, BLOCK, "value").mapInArrow(report, REPORT)


RECORD = f"{SOURCE} string, {BLOCK} long, {PLACE} long, record string, first boolean, chain long"


def _joined(lines: DataFrame, sep: str) -> DataFrame:
    """Records of every block, and the parts of records that run over its edges (``chain``: the block they begin in).

    ``first`` marks the first record of a file that is not blank.
    """
    schema = pa.schema([(SOURCE, pa.string()), (BLOCK, pa.int64()), (PLACE, pa.int64()), ("record", pa.string()), ("first", pa.bool_()), ("chain", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, chain, place, opening = None, [], False, None, 0, False
        out: list[tuple] = []

        def emit(begun_in: int | None) -> None:
            nonlocal opening
            first = opening and any(line.strip("\r") for line in held)
            opening = opening and not first
            out.append((*key, place, "\n".join(held), first, begun_in))
            held.clear()

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(column, f.type) for column, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        for here, rows in runs(batches):
            if here != key:
                if held:
                    emit(key[1] if chain is None else chain)
                key, inside, chain = here, rows.column(4)[0].as_py(), rows.column(5)[0].as_py()
                if inside is None:
                    raise RuntimeError("the blocks of the input have changed between two reads; keep the number of executors or set spark.sql.files.minPartitionNum")
                chain, opening = chain if inside else None, key[1] == 0
            for at, line in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if not held:
                    place = at
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, sep, inside)
                if not inside:
                    emit(chain)
                    chain = None
            if len(out) > 10_000:
                yield batch()
        if held:
            emit(key[1] if chain is None else chain)
        if out:
            yield batch()

    return lines.select(SOURCE, BLOCK, PLACE, "value", "begins_inside", "begun_in").mapInArrow(join, RECORD)


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``_src, _block, _place, record, first``: whole records of all files. A quote that is never closed is an error."""
    lines = pieces(spark, path, "\n")
    marked = (F.col(BLOCK) == 0) & F.col("value").startswith(BOM)
    lines = lines.withColumn("value", F.when(marked, F.expr("substring(value, 2)")).otherwise(F.col("value")))
    told = with_state(block_reports(lines, sep))
    ends = F.when(F.col("begins_inside"), F.col("inside")).otherwise(F.col("out"))
    starts = ~F.col("begins_inside") | F.col("closes")  # a record begins in this block
    before = Window.partitionBy(SOURCE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("begun_in", F.last(F.when(starts, F.col(BLOCK)), ignorenulls=True).over(before)).withColumn("ends_inside", ends)
    told = materialize(told.select(SOURCE, BLOCK, "begins_inside", "begun_in", "ends_inside"), "csv-blocks")
    last = told.groupBy(SOURCE).agg(F.max_by("ends_inside", BLOCK).alias("open"), F.max_by("begun_in", BLOCK).alias("block"))
    bad = last.where("open").select(SOURCE).first()
    if bad:
        raise ValueError(f"a quote in {bad[0]} is never closed")
    joined = _joined(with_report(lines, told.drop("ends_inside")), sep)
    if told.where("begins_inside").isEmpty():
        return joined.drop("chain")
    joined = materialize(joined, "csv-records")
    parts = joined.where("chain IS NOT NULL").groupBy(SOURCE, "chain").agg(F.array_sort(F.collect_list(F.struct(BLOCK, PLACE, "record"))).alias("parts"), F.bool_or("first").alias("first"))
    whole = parts.select(
        SOURCE, F.col("chain").alias(BLOCK), F.get("parts", F.lit(0))[PLACE].alias(PLACE), F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "first"
    )
    return joined.where("chain IS NULL").drop("chain").unionByName(whole)


def first_record(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Cells of the first record of the first file by name (a bounded read)."""
    first = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    if first is None:
        return []
    asked = HEAD_LINES
    while True:
        lines = [r["value"] for r in spark.read.option("lineSep", "\n").text(first).limit(asked).collect()]
        inside, record = False, []
        for line in lines:
            if not record and line.strip("\r" + BOM) == "":
                continue
            record.append(line)
            inside = ends_inside(line.removeprefix(BOM), sep, inside)
            if not inside:
                return cells("\n".join(record), sep)
        if len(lines) < asked:
            return cells("\n".join(record), sep) if record else []
        asked *= 2


def cells(record: str, sep: str) -> list[str]:
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([record.removeprefix(BOM).removesuffix("\r")], delimiter=sep), [])


def scan_csv_placed(spark: SparkSession, path: str, sep: str, has_header: bool, columns: list[str] | None) -> DataFrame:
    """Text columns and the place of every record (``_src, _block, _place``). Blank lines are skipped."""
    head = [] if columns else first_record(spark, path, sep)
    names = columns or (unique(head) if has_header else [f"col_{k + 1}" for k in range(len(head))])
    records = csv_records(spark, path, sep)
    text = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    records = records.withColumn("record", text).where(F.col("record") != "")
    if has_header:
        records = records.where("NOT first")
    if not names:
        return records.drop("record", "first")
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, 2 * len(names)))}
    parsed = records.withColumn("_cells", F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    return parsed.select(SOURCE, BLOCK, PLACE, *[F.coalesce(F.col(f"_cells.c{k}"), F.lit("")).alias(name) for k, name in enumerate(names)])


def unique(names: list[str]) -> list[str]:
    """Header cells as column names: an empty or repeated one gets its place added, as Spark's reader does."""
    low = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if low.count(n.lower()) > 1 else n for k, n in enumerate(names)]
