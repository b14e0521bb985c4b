"""Column profile of a table: dominant type, empty cells, first distinct values."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reqweave.functions.jsonvals import cell_text, is_nested, value_kind
from reqweave.functions.text import is_empty_value
from reqweave.operators.ordering import ROW
from reqweave.storage import materialize

EXAMPLES = 3
TYPES = ["array", "bool", "number", "object", "string"]


def type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "object" if isinstance(dtype, (T.StructType, T.MapType)) else "string"


def value_type(c: Column, dtype: T.DataType) -> Column:
    """bool, number, array, object, else string; by schema, or by value for VARIANT."""
    if isinstance(dtype, T.VariantType):
        kind = value_kind(c)
        return F.when(kind == "null", F.lit(None)).otherwise(kind)
    return F.lit(type_name(dtype))


def dominant_type(counts: dict[str, Column]) -> Column:
    """Type with the most values, the first by name among equals, ``empty`` if none."""
    best = F.lit("empty")
    top = F.greatest(*counts.values())
    for name in sorted(counts, reverse=True):
        best = F.when((top > 0) & (counts[name] == top), name).otherwise(best)
    return best


class Sketch:
    """What a task knows of a column: values by kind, and the ``most`` first distinct values with their rows.

    Sketches merge without loss: a value among the first of the whole table is among the first of the task that holds its
    first row.
    """

    def __init__(self, most: int, kind: pa.DataType):
        self.most, self.counts = most, {}
        self.first = pa.table({"v": pa.array([], kind), "r": pa.array([], pa.int64())})

    def add(self, rows: pa.Array, values: pa.Array, kinds: pa.Array | None) -> None:
        """Cells of a batch; empty ones are null."""
        if kinds is None:
            self.counts[""] = self.counts.get("", 0) + len(values) - values.null_count
        else:
            for c in pc.value_counts(kinds).to_pylist():
                if c["values"] is not None:
                    self.counts[c["values"]] = self.counts.get(c["values"], 0) + c["counts"]
        filled = pc.is_valid(values)
        if len(self.first) >= self.most:  # later rows cannot be among the first any more
            filled = pc.and_(filled, pc.less(rows, pc.max(self.first["r"])))
        if self.most and pc.any(filled).as_py():
            new = pa.table({"v": values.filter(filled), "r": rows.filter(filled)})
            both = pa.concat_tables([self.first, new]).group_by("v").aggregate([("r", "min")])
            self.first = both.rename_columns(["v", "r"]).sort_by("r").slice(0, self.most).combine_chunks()


def column_sketches(df: DataFrame, names: list[str], examples: int) -> DataFrame:
    """``_col, _kind, _count, _row, c0, c1, ..``: per task and column, counts by kind and first values (in the column's own ``c``)."""
    types = [df.schema[n].dataType for n in names]
    cells = [F.col(f"`{n}`") for n in names]
    # distinct by value; nested values, which cannot be compared, by their JSON text
    shown = [T.StringType() if is_nested(t) else t for t in types]
    kinds = [value_type(c, t) for c, t in zip(cells, types, strict=True)]
    filled = [~is_empty_value(c, t) & k.isNotNull() for c, t, k in zip(cells, types, kinds, strict=True)]
    same = [cell_text(c, t) if is_nested(t) else c for c, t in zip(cells, types, strict=True)]
    free = [k for k, t in enumerate(types) if isinstance(t, T.VariantType)]
    sent = df.select(
        F.col(ROW).cast("long").alias("_row"), *[F.when(f, v).alias(f"c{k}") for k, (f, v) in enumerate(zip(filled, same, strict=True))],
        *[F.when(filled[k], kinds[k]).alias(f"k{k}") for k in free],
    )
    arrow = [to_arrow_type(t) for t in shown]
    fields = [("_col", pa.int32()), ("_kind", pa.string()), ("_count", pa.int64()), ("_row", pa.int64())]
    schema = pa.schema(fields + [(f"c{k}", t) for k, t in enumerate(arrow)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = [Sketch(examples, t) for t in arrow], 0
        for batch in batches:
            total += batch.num_rows
            for k, s in enumerate(own):
                kind = batch.column(1 + len(own) + free.index(k)) if k in free else None
                s.add(batch.column(0), batch.column(1 + k).cast(arrow[k]), kind)
        yield pa.RecordBatch.from_pylist([{"_col": -1, "_count": total}], schema)
        for k, s in enumerate(own):
            yield pa.RecordBatch.from_pylist([{"_col": k, "_kind": kind, "_count": n} for kind, n in s.counts.items()], schema)
            n = len(s.first)
            columns = {"_col": pa.array([k] * n, pa.int32()), "_row": s.first["r"].combine_chunks(), f"c{k}": s.first["v"].combine_chunks()}
            made = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], schema=schema)

    out = T.StructType(
        [T.StructField("_col", T.IntegerType()), T.StructField("_kind", T.StringType()), T.StructField("_count", T.LongType()), T.StructField("_row", T.LongType())]
        + [T.StructField(f"c{k}", t) for k, t in enumerate(shown)]
    )
    return sent.mapInArrow(sketch, out)


def column_profile(df: DataFrame, columns: list[str] | None = None, examples: int = EXAMPLES) -> DataFrame:
    """``(column, type, empty, examples)`` of every column; needs a row number.

    One pass over ``df`` for any number of examples: every task makes a sketch of each column, the sketches are written and
    merged. What is merged are ``examples`` values a column and task, so no column is shuffled by value.
    """
    names = columns or [c for c in df.columns if c != ROW]
    types = [df.schema[n].dataType for n in names]
    written = materialize(column_sketches(df, names, examples), "sketches")
    counted = written.where("_row IS NULL").groupBy("_col", "_kind").agg(F.sum("_count").alias("n")).collect()
    total = sum(r["n"] for r in counted if r["_col"] < 0)
    by_kind: list[dict[str, int]] = [{} for _ in names]
    for r in counted:
        if r["_col"] >= 0 and r["n"]:
            kind = r["_kind"] or type_name(types[r["_col"]])
            by_kind[r["_col"]][kind] = r["n"]
    values = [f"c{k}" for k in range(len(names))]
    first = written.where("_row IS NOT NULL").groupBy("_col", *values).agg(F.min("_row").alias("_row"))
    order = Window.partitionBy("_col").orderBy("_row")
    nearest = first.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= examples)
    text = F.lit(None).cast("string")
    for k, t in enumerate(types):
        text = F.when(F.col("_col") == k, cell_text(F.col(f"c{k}"), T.StringType() if is_nested(t) else t)).otherwise(text)
    texts: list[list[str]] = [[] for _ in names]
    for r in sorted(nearest.select("_col", "_place", text.alias("text")).collect()):
        texts[r["_col"]].append(r["text"])
    profile = [
        (n, min(counts, key=lambda c: (-counts[c], c)) if counts else "empty", total - sum(counts.values()), shown)
        for n, counts, shown in zip(names, by_kind, texts, strict=True)
    ]
    return df.sparkSession.createDataFrame(profile, "column string, type string, empty long, examples array<string>")
