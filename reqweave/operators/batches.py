"""Several neighbouring records in one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reqweave.functions.jsonvals import framed, framed_value, object_fields
from reqweave.functions.text import trim_space
from reqweave.operators.answers import BAD_OBJECT, job_error, parse_array
from reqweave.operators.ordering import ROW
from reqweave.operators.spec import OneJob

# Batch prompt texts and errors.
HEAD = "Process the following {n} records. Return ONLY a valid JSON array containing exactly {n} JSON objects, one per record, in the same order.\n"
FIELDS_HEAD = "Each object must contain exactly these fields:\n"
NO_REASONING = "Do not include reasoning text. Return only the JSON array.\n"


def make_batches(df: DataFrame, size: int, carry: list[str] | None = None) -> DataFrame:
    """Groups of ``size`` consecutive records: ``batch_id`` and ``rows`` in order.

    A batch holds at most ``size`` records, so the one shuffle is even whatever the
    data looks like. ``rows`` carries the records: nothing is joined back later.
    """
    names = [c for c in (carry if carry is not None else df.columns) if c != ROW]
    row = F.struct(ROW, *[F.col(f"`{c}`") for c in names])
    return (
        df.groupBy(F.floor(F.col(ROW) / size).alias("batch_id"))
        .agg(F.collect_list(row).alias("rows"))
        .withColumn("rows", F.array_sort("rows", lambda a, b: (a[ROW] - b[ROW]).cast("int")))
    )


def batch_user_text(rows: Column, payload: str, batch_lines: Column, thinking: Column, post: str = "") -> Column:
    """Prompt for one batch; every payload is an indented JSON text already."""
    n = F.size(rows).cast("string")
    start, middle, end = HEAD.split("{n}")
    head = F.concat(F.lit(start), n, F.lit(middle), n, F.lit(end))
    fields = F.coalesce(F.concat(F.lit(FIELDS_HEAD), batch_lines), F.lit(""))
    items = F.transform(rows, lambda r: F.concat(F.lit("  "), F.replace(r[payload], F.lit("\n"), F.lit("\n  "))))
    listed = F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n]"))
    note = F.when(thinking, NO_REASONING).otherwise("")
    text = F.concat(head, fields, note, F.lit("\n"), listed)
    return F.concat(text, F.lit("\n\n" + post)) if post else text


def raw_items(text: Column) -> Column:
    """Items of an array text as they are spelled; strings without their quotes."""
    return F.transform(F.from_json(text, T.ArrayType(T.StringType())), lambda s: F.coalesce(s, F.lit("null")))


def check_batch(df: DataFrame, job: OneJob, response: str = "response") -> DataFrame:
    """Strict batch answers. Adds ``items`` (member maps) and ``error``.

    One bad item fails its batch; everything is decided inside the batch row.
    """
    parsed = parse_array(df, response)
    expected, got = F.size("rows"), F.size("items")
    mismatch = F.concat(
        F.lit("batch response length mismatch: expected "), expected.cast("string"),
        F.lit(" objects, got "), got.cast("string"),
    )
    objects = F.transform("items", lambda v: object_fields(v))
    named = lambda i, problem: F.concat(F.lit("batch response item "), i.cast("string"), F.lit(": "), problem)
    problems = F.transform(
        objects, lambda o, i: named(i, F.when(o.isNull(), BAD_OBJECT).otherwise(job_error(o, job)))
    )
    first = F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))
    return (
        parsed.withColumn("_raw", raw_items(trim_space(F.col(response))))
        .withColumn("error", F.coalesce("error", F.when(expected != got, mismatch), first))
        .withColumn("items", F.when(F.col("error").isNull(), objects))
    )


def split_batch_strict(df: DataFrame, job: OneJob, response: str = "response", keep: list[str] = ()) -> DataFrame:
    """One row per record: its columns, ``parsed``, ``item`` (raw answer), ``error``
    and the columns of the batch named in ``keep``."""
    checked = check_batch(df, job, response)
    return _spread(checked.withColumn("item", F.when(F.col("error").isNull(), F.col("_raw"))), keep)


def split_batch_lenient(df: DataFrame, response: str = "response", keep: list[str] = ()) -> DataFrame:
    """Whatever the answer holds between the outer brackets, spread over the records.

    No array: every record gets the whole answer. Objects are spread, strings kept
    as they are, missing items become empty text; nothing is ever an error.
    """
    t = trim_space(F.col(response))
    from_open = F.when(F.locate("[", t) > 0, F.substring(t, F.locate("[", t), F.length(t))).otherwise(t)
    close = F.length(from_open) - F.length(F.substring_index(from_open, "]", -1))
    cut = F.when(F.contains(from_open, F.lit("]")), F.substring(from_open, F.lit(1), close)).otherwise(from_open)
    value = framed_value(F.col("_frame"))
    got = (
        df.withColumn("_cut", cut).withColumn("_frame", framed(F.col("_cut")))
        .withColumn("_items", F.when(F.is_variant_null(value), F.array().cast("array<variant>")).otherwise(F.try_variant_get(value, "$", "array<variant>")))
        .withColumn("items", F.transform("_items", lambda v: object_fields(v)))
        .withColumn("item", F.when(F.col("_items").isNotNull(), raw_items(F.col("_cut"))))
        .withColumn("_whole", F.when(F.col("_items").isNull(), F.col(response)))
        .withColumn("error", F.lit(None).cast("string"))
    )
    out = _spread(got.drop("_cut", "_frame", "_items"), ["_whole", *keep])
    return out.withColumn("item", F.coalesce("_whole", "item", F.lit(""))).drop("_whole")


def _spread(df: DataFrame, keep: list[str]) -> DataFrame:
    picked = df.select("batch_id", "error", "items", "item", *keep, F.posexplode("rows").alias("_at", "_row"))
    return picked.select(
        "batch_id", "_row.*",
        F.get("items", F.col("_at")).alias("parsed"),
        F.get("item", F.col("_at")).alias("item"),
        "error", *keep,
    )


def keep_failed_rows(split: DataFrame, out: str = "response") -> DataFrame:
    """Rows of a failed batch stay, with an empty response."""
    return split.withColumn(out, F.coalesce("item", F.lit("")))
