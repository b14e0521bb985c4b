"""The answer specification as data: ``spec(job_id, field, hint)``.

One run can serve many jobs. A job's fields all go into its prompt, so the rows
of one job are few; grouping by job keeps each group as small as a prompt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reqweave.functions.hints import describe_hint, example_value, infer_kind, parse_enum, placeholder_value
from reqweave.functions.jsonvals import quoted
from reqweave.functions.text import is_blank, trim_space

SPEC_SCHEMA = "job_id string, field string, hint string"
FIELD_TYPE = "array<struct<field:string,kind:string,allowed:array<string>>>"

# Prompt texts that a job's answers are asked for with.
THINK_FIRST = (
    "Step 1 — Reason: think through the task step by step inside a <thinking>...</thinking> block.\n"
    "Step 2 — Answer: immediately after the closing </thinking> tag output your final answer.\n\n"
    "The final answer (after </thinking>) must be ONLY a single JSON object."
)
ONE_OBJECT = "Output ONLY a single JSON object."
NOTHING_ELSE = " No markdown. No code fences (```). No text before or after the JSON.\n"
FIELDS_HEAD = "\nThe JSON object must contain exactly these fields — no more, no fewer:\n"
EXAMPLE_HEAD = "\nExpected format (replace placeholder values with actual values):\n"
NOTE_THINKING = (
    "You must always reason inside a <thinking>...</thinking> block first, "
    "then respond with a single valid JSON object. "
    "Never include any text, markdown, or code blocks outside those boundaries."
)
NOTE_PLAIN = (
    "You must always respond with a single valid JSON object. "
    "Never include text, markdown, or code blocks before or after the JSON."
)
REPAIR_SYSTEM = (
    "You are a strict JSON formatter. Always respond with a single valid JSON object "
    "— no markdown, no code fences, no explanation."
)
REPAIR_HEAD = (
    "Convert the text below into a single valid JSON object. "
    "Output ONLY the JSON — no markdown, no code fences, no explanations.\n"
)
REPAIR_FIELDS = "\nRequired fields:\n"
REPAIR_EXAMPLE = "\nExpected format:\n"
REPAIR_TEXT = "\nText to convert:\n"
DEFAULT_FIELD = "response"
DEFAULT_DEBUG_HINT = "short explanation in one sentence"
STRUCTURED_FORMATS = ["json", "xml", "csv"]


def spec_frame(spark: SparkSession, schema: dict[str, str], job_id: str = "job") -> DataFrame:
    return spark.createDataFrame([(job_id, k, v) for k, v in schema.items()], SPEC_SCHEMA)


def effective_schema(spec: DataFrame, jobs: DataFrame) -> DataFrame:
    """Fields each job's answers are held to.

    ``jobs(job_id, debug_field, debug_hint, response_field, response_format,
    parse_json)``. The debug field is added (its hint wins over an equal name); a
    job left without fields gets one text field, unless it asked for free JSON.
    """
    debug = jobs.where(~is_blank(F.col("debug_field"))).select(
        "job_id",
        F.col("debug_field").alias("field"),
        F.when(is_blank(F.col("debug_hint")), DEFAULT_DEBUG_HINT).otherwise(F.col("debug_hint")).alias("hint"),
    )
    explicit = spec.select("job_id", "field", "hint").join(debug, ["job_id", "field"], "left_anti").unionByName(debug)
    wants_fields = ~(
        F.coalesce(F.col("parse_json"), F.lit(False))
        | F.coalesce(F.lower(trim_space(F.col("response_format"))).isin(STRUCTURED_FORMATS), F.lit(False))
    )
    name = trim_space(F.col("response_field"))
    fallback = jobs.where(wants_fields).join(explicit, "job_id", "left_anti").select(
        "job_id",
        F.when(is_blank(name), DEFAULT_FIELD).otherwise(name).alias("field"),
        F.lit("string").alias("hint"),
    )
    return explicit.unionByName(fallback)


def describe_fields(spec: DataFrame) -> DataFrame:
    """Adds kind, allowed, description, example and placeholder to each field."""
    return (
        spec.withColumn("allowed", parse_enum(F.col("hint")))
        .withColumn("kind", infer_kind(F.col("hint"), F.col("allowed")))
        .withColumns(
            {
                "description": describe_hint(F.col("hint")),
                "example": example_value(F.col("hint")),
                "placeholder": placeholder_value(F.col("kind"), F.col("allowed")),
            }
        )
    )


def compile_spec(spec: DataFrame) -> DataFrame:
    """One row per job: checked fields and the prompt texts made from them."""
    d = describe_fields(spec)
    key = F.concat(quoted(F.col("field")), F.lit(":"))
    entry = F.struct(
        "field", "kind", "allowed", "hint", "description",
        F.concat(key, F.col("example")).alias("example"),
        F.concat(key, F.col("placeholder")).alias("placeholder"),
    )
    rows = d.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("_f"))

    def joined(each, sep: str) -> Column:
        return F.array_join(F.transform(F.col("_f"), each), sep)

    return rows.select(
        "job_id",
        F.transform("_f", lambda f: F.struct(f["field"].alias("field"), f["kind"].alias("kind"), f["allowed"].alias("allowed"))).alias("fields"),
        joined(lambda f: F.concat(F.lit('  - "'), f["field"], F.lit('": '), f["description"], F.lit("\n")), "").alias("field_lines"),
        joined(lambda f: F.concat(F.lit("- "), f["field"], F.lit(": "), f["hint"], F.lit("\n")), "").alias("batch_lines"),
        F.concat(F.lit("{"), joined(lambda f: f["example"], ","), F.lit("}")).alias("example"),
        F.concat(F.lit("{"), joined(lambda f: f["placeholder"], ","), F.lit("}")).alias("dry_answer"),
    )


@dataclass(frozen=True)
class OneJob:
    """The compiled row of one job on the driver; as small as its prompt."""

    fields: tuple[tuple[str, str, tuple[str, ...] | None], ...] = ()
    field_lines: str | None = None
    batch_lines: str | None = None
    example: str | None = None
    dry_answer: str | None = None

    @property
    def kinds(self) -> dict[str, str]:
        return {name: kind for name, kind, _ in self.fields}

    def text(self, name: str) -> Column:
        return F.lit(getattr(self, name)).cast("string")


def one_job(spec: DataFrame, job_id: str = "job") -> OneJob:
    """Read one job's compiled row; a job without fields has an empty one."""
    row = compile_spec(spec.where(F.col("job_id") == job_id)).first()
    if row is None:
        return OneJob()
    fields = tuple((f["field"], f["kind"], tuple(f["allowed"]) if f["allowed"] else None) for f in row["fields"])
    return OneJob(fields, row["field_lines"], row["batch_lines"], row["example"], row["dry_answer"])


def example_json(spec: DataFrame) -> DataFrame:
    return compile_spec(spec).select("job_id", "example")


def instructions_text(thinking: Column, field_lines: Column, example: Column) -> Column:
    """Format instructions; jobs without fields (nulls) only get the first part."""
    head = F.concat(F.when(thinking, THINK_FIRST).otherwise(ONE_OBJECT), F.lit(NOTHING_ELSE))
    body = F.concat(F.lit(FIELDS_HEAD), field_lines, F.lit(EXAMPLE_HEAD), example, F.lit("\n"))
    return F.concat(head, F.coalesce(body, F.lit("")))


def system_text(system: Column, structured: Column, thinking: Column) -> Column:
    """System prompt, followed by the note where answers are structured."""
    note = F.when(thinking, NOTE_THINKING).when(structured, NOTE_PLAIN)
    with_note = F.when(is_blank(system), note).otherwise(F.concat_ws("\n\n", trim_space(system), note))
    return F.when(note.isNotNull(), with_note).otherwise(F.coalesce(system, F.lit("")))


def repair_text(response: Column, field_lines: Column, example: Column) -> Column:
    """Prompt that asks to rewrite a bad answer."""
    fields = F.concat(F.lit(REPAIR_FIELDS), field_lines, F.lit(REPAIR_EXAMPLE), example, F.lit("\n"))
    return F.concat(F.lit(REPAIR_HEAD), F.coalesce(fields, F.lit("")), F.lit(REPAIR_TEXT), F.coalesce(response, F.lit("")))


def format_instructions(spec: DataFrame, jobs: DataFrame) -> DataFrame:
    """``jobs(job_id, thinking)`` to ``(job_id, instructions)``."""
    text = instructions_text(F.col("thinking"), F.col("field_lines"), F.col("example"))
    return jobs.join(compile_spec(spec), "job_id", "left").select("job_id", text.alias("instructions"))
