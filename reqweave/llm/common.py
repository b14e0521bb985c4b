"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqweave.session import prepare

#: Rows and bytes of one Arrow batch: what a task and its Python worker hold of whole texts at a time (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def start(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and bound the Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return start(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def write_dense(spark: SparkSession) -> SparkSession:
    """Parquet is written with zstd from here on, unless the session was given a codec: Snappy leaves digits of random words as long as they are."""
    if (codec := "spark.sql.parquet.compression.codec") not in spark.conf.getAll:
        spark.conf.set(codec, "zstd")
    return spark


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of a table whatever its other columns are called; a null text becomes empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema for a flat list such as ``doc_id long, text string``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds["float"] = pa.float32()
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


#: What a Python worker remembers between batches, by operator: how to forget it.
_MEMORIES: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Workers serve one stage after the other; each operator says how its memory is given back."""
    _MEMORIES[name] = forget


def only(name: str) -> None:
    """Called at the start of a task: the memories of all other operators are given back."""
    for other, forget in _MEMORIES.items():
        if other != name:
            forget()
