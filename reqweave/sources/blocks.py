"""State that carries on from one block of a file to the next.

A big text file is read as blocks by many tasks. Whether a block begins inside a quoted cell, or inside a JSON string, only
the blocks before it can tell; so every block reports what it would make of both cases, and a prefix over
the blocks of a file puts the reports together. Reports are one row per block; texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqweave.storage import materialize

#: Where a piece of text stands: file, first byte of its block, place among the pieces of a task.
SOURCE, BLOCK, PLACE = "_src", "_block", "_place"
SIZE = "_size"
BOM = "\ufeff"


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``_src, _block, _place, value, _size``: the text between separators, big files in blocks, and the bytes of the file."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(PLACE), "value",
        F.col("_metadata.file_size").alias(SIZE),
    )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows of one block, with the block's key; the first two columns are file and block."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            key = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
            if (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()) == key:
                stop = batch.num_rows
            else:
                low, high = at, batch.num_rows - 1  # blocks lie one after the other
                while high - low > 1:
                    half = (low + high) // 2
                    same = (batch.column(0)[half].as_py(), batch.column(1)[half].as_py()) == key
                    low, high = (half, high) if same else (low, half)
                stop = high
            yield key, batch.slice(at, stop - at)
            at = stop


def with_state(reports: DataFrame, out: str = "out", inside: str = "inside", name: str = "begins_inside") -> DataFrame:
    """``reports`` with whether each block begins inside, from where it ends if it begins outside (``out``) or inside (``inside``).

    A block keeps the state, swaps it, or ends in one state whatever came before. The state is that of the last
    block with a fixed end, swapped as often as the blocks behind it swap.
    """
    order = Window.partitionBy(SOURCE).orderBy(BLOCK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col(out) & ~F.col(inside)).cast("long")
    counted = reports.withColumn("_swaps", F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col(out) == F.col(inside), F.struct(F.col(out).cast("long").alias("end"), "_swaps"))
    last = F.last(fixed, ignorenulls=True).over(before)
    end, then = F.coalesce(last["end"], F.lit(0)), F.coalesce(last["_swaps"], F.lit(0))
    swaps = F.coalesce(F.lag("_swaps").over(order), F.lit(0))
    return counted.withColumn(name, (end + swaps - then) % 2 == 1).drop("_swaps")


def with_report(placed: DataFrame, reports: DataFrame) -> DataFrame:
    """Pieces with the report of their block, in order inside the partitions however the join is done."""
    joined = placed.join(reports, [SOURCE, BLOCK], "left")
    return joined.sortWithinPartitions(SOURCE, BLOCK, PLACE)


def with_folders(spark: SparkSession, path: str, rows: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """``rows`` (with ``_src``) and the values of partition folders (``name=value``) on the way to their files.

    Only the listing of the files is read. Folders win over members of the same name, as in Spark's own readers.
    """
    files = spark.read.format("binaryFile").load(path)
    names = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    if not names:
        return rows
    kinds = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    values = [F.col(f"`{n}`").cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names]
    told = materialize(files.select(F.col("_metadata.file_path").alias(SOURCE), *values), "folders")
    return rows.drop(*names).join(told, SOURCE)
