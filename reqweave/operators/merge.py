"""Checked answers back onto their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqweave.functions.jsonvals import cell_text
from reqweave.functions.text import strip_thinking


def carry_input(columns: list[str], include: bool = True, key_column: str = "") -> list[str]:
    """Names of the input columns that reach the output."""
    if not include:
        return []
    return [c for c in columns if c == key_column] if key_column else list(columns)


def output_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Project to the listed columns that exist; no list keeps all."""
    return df.select(*[F.col(f"`{c}`") for c in fields if c in df.columns]) if fields else df


def stored_response(
    raw: Column, parsed: Column, thinking: bool = False, show_thinking: bool = True
) -> Column:
    """Answer text to keep: as received, or without its reasoning part."""
    if not thinking or show_thinking:
        return raw
    return F.when(F.size(parsed) > 0, F.to_json(parsed)).otherwise(strip_thinking(raw))


def store_response(
    df: DataFrame, field: str, raw: str = "response", thinking: bool = False,
    show_thinking: bool = True, keep_raw: bool = True, parsed_names: list[str] = (),
) -> DataFrame:
    """Write the answer text to ``field`` unless switched off or answered by a member."""
    if not keep_raw or not field.strip() or field in parsed_names:
        return df
    return df.withColumn(field, stored_response(F.col(raw), F.col("parsed"), thinking, show_thinking))


def key_conflict(parsed: Column, columns: list[str], response_field: str = "response") -> Column:
    """True when a member overwrites an input column."""
    names = [c for c in columns if c != response_field]
    return F.arrays_overlap(F.map_keys(parsed), F.array(*map(F.lit, names)).cast("array<string>"))


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns are the sorted union of their names."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def member_names(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Distinct member names of all answers, one row per name."""
    return df.select(F.explode(F.map_keys(parsed)).alias("name")).distinct()


def stringify(df: DataFrame) -> DataFrame:
    """Every column as cell text."""
    return df.select(*[cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
