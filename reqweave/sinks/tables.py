"""Rows into a database table through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reqweave.functions.jsonvals import cell_text, is_nested

TEXT_TYPE = "CLOB"
BATCH = 10_000


def database_cells(df: DataFrame) -> DataFrame:
    """Scalars stay as they are, nested values become JSON text."""
    return df.select(*[
        (cell_text(F.col(f"`{f.name}`"), f.dataType) if is_nested(f.dataType) else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields
    ])


def text_cells(df: DataFrame) -> DataFrame:
    """Text for a table whose columns are all nullable text; null stays null."""
    return df.select(*[
        F.when(F.col(f"`{f.name}`").isNotNull(), cell_text(F.col(f"`{f.name}`"), f.dataType)).alias(f.name)
        for f in df.schema.fields
    ])


def sink_sql(df: DataFrame, url: str, table: str, text_type: str = TEXT_TYPE, **extra) -> None:
    """Append to ``table``; a missing table is created with nullable text columns."""
    if not url.strip() or not table.strip():
        raise ValueError("missing connection url or table")
    columns = ", ".join(f"`{c}` {text_type}" for c in df.columns)
    text_cells(df).write.mode("append").format("jdbc").options(
        url=url, dbtable=table, batchsize=BATCH, createTableColumnTypes=columns, **extra
    ).save()
