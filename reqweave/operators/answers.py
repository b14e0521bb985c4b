"""Answer text to checked fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqweave.functions.jsonvals import array_items, framed, framed_value, member_map, object_fields
from reqweave.functions.salvage import extract_first_json, extract_last_json, escape_control_chars
from reqweave.functions.text import CLOSE_THINKING, trim_space
from reqweave.operators.hotkeys import spread_join
from reqweave.operators.spec import OneJob

# Tags and error texts.
OPEN_THINKING = "<thinking>"
EMPTY = "response is empty"
NO_CLOSE = "thinking mode requires a closing </thinking> tag"
NO_ANSWER = "missing final JSON object after </thinking>"
BAD_OBJECT = "invalid JSON object"
BAD_ARRAY = "invalid JSON array"
BAD_KEYS = "response JSON keys do not match response_schema"

MAP = "map<string,variant>"


def unwrap_code_fence(text: Column) -> Column:
    """Inside of a fenced block: first line dropped, closing fence required."""
    inner = F.regexp_extract(trim_space(text), r"(?s)^```[^\n]*\n(.*)```\z", 1)
    return F.nullif(trim_space(inner), F.lit(""))


def without_thinking(text: Column, thinking: Column) -> Column:
    """The answer part of a text that may start with reasoning."""
    t = trim_space(text)
    return F.when(thinking, trim_space(F.regexp_replace(t, r"(?s)^<thinking>.*?</thinking>", ""))).otherwise(t)


def thinking_error(text: Column, thinking: Column) -> Column:
    """What is wrong with the frame of an answer, before its JSON is looked at."""
    t = trim_space(F.coalesce(text, F.lit("")))
    opened = thinking & t.startswith(OPEN_THINKING)
    return (
        F.when(t == "", EMPTY)
        .when(opened & ~F.contains(t, F.lit(CLOSE_THINKING)), NO_CLOSE)
        .when(opened & (without_thinking(t, thinking) == ""), NO_ANSWER)
    )


def split_thinking(text: Column, thinking: Column) -> Column:
    """struct(body, error)."""
    error = thinking_error(text, thinking)
    return F.struct(F.when(error.isNull(), without_thinking(text, thinking)).alias("body"), error.alias("error"))


def parse_strict(df: DataFrame, response: str = "response", thinking: Column | None = None) -> DataFrame:
    """Adds ``parsed`` (member map) and ``error``: exactly one JSON object, bare or fenced.

    Built in steps so that each text is parsed once, with few uses of each step so
    that a filter on the result, which Spark merges into one expression, stays small.
    """
    thinking = F.lit(False) if thinking is None else thinking
    nothing = F.create_map().cast(MAP)
    return (
        df.withColumn("_body", without_thinking(F.col(response), thinking))
        .withColumn("_frame", framed(F.col("_body")))
        .withColumn("parsed", member_map(framed_value(F.col("_frame"))))
        .withColumn("_inner", F.when(F.col("parsed").isNull(), unwrap_code_fence(F.col("_body"))))
        .withColumn("_frame", framed(F.col("_inner")))
        .withColumn(
            "parsed",
            F.coalesce(
                "parsed", member_map(framed_value(F.col("_frame"))),
                F.when(F.coalesce("_inner", "_body") == "null", nothing),
            ),
        )
        .withColumn("error", F.when(F.col("parsed").isNull(), F.coalesce(thinking_error(F.col(response), thinking), F.lit(BAD_OBJECT))))
        .drop("_body", "_frame", "_inner")
    )


def parse_lenient(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``parsed`` from the last object in mixed text; finding none is no error."""
    return (
        df.withColumn("_json", extract_last_json(F.col(response)))
        .withColumn("parsed", object_fields(F.try_parse_json("_json")))
        .withColumn("error", F.lit(None).cast("string"))
        .drop("_json")
    )


def parse_array(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``items`` and ``error``: exactly one JSON array (null counts as an empty one)."""
    nothing = F.array().cast("array<variant>")
    return (
        df.withColumn("_frame", framed(trim_space(F.col(response))))
        .withColumn("_value", framed_value(F.col("_frame")))
        .withColumn("items", F.when(F.is_variant_null("_value"), nothing).otherwise(array_items(F.col("_value"))))
        .withColumn("error", F.when(F.col("items").isNull(), BAD_ARRAY))
        .drop("_frame", "_value")
    )


def salvage_object(df: DataFrame, text: str, out: str = "salvaged") -> DataFrame:
    """First object of a text as a member map; raw control characters are escaped
    when the plain text does not parse."""
    return (
        df.withColumn("_json", extract_first_json(F.col(text)))
        .withColumn("_first", F.try_parse_json("_json"))
        .withColumn("_fixed", escape_control_chars(F.when(F.col("_first").isNull(), F.col("_json"))))
        .withColumn(out, object_fields(F.coalesce("_first", F.try_parse_json("_fixed"))))
        .drop("_json", "_first", "_fixed")
    )


def key_error(parsed: Column, wanted: Column) -> Column:
    """Sorted missing and extra members against the wanted names, or null."""
    present = F.map_keys(parsed)
    missing, extra = F.array_except(wanted, present), F.array_sort(F.array_except(present, wanted))
    parts = F.concat_ws(
        "; ",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        F.when(F.size(extra) > 0, F.concat(F.lit("extra: "), F.array_join(extra, ", "))),
    )
    return F.when((F.size(wanted) > 0) & (parts != ""), F.concat(F.lit(BAD_KEYS + " ("), parts, F.lit(")")))


def _problem(kind: str, value: Column, allowed: Column) -> Column | None:
    """What is wrong with a value of a hinted kind; each kind looks at it its own way."""
    t, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    # numbers too big for a double are no numbers
    real = (t.startswith("DECIMAL") | (t == "DOUBLE")) & (F.abs(number) < float("inf"))
    if kind == "enum":
        listed = F.array_join(allowed, "|")
        not_text = F.concat(F.lit(" must be a string enum ("), listed, F.lit(")"))
        listed_one = F.array_contains(allowed, F.try_variant_get(value, "$", "string"))
        return F.when(t != "STRING", not_text).when(~listed_one, F.concat(F.lit(" must be one of "), listed))
    if kind == "int":
        return F.when(t == "BIGINT", None).when(real & (F.rint(number) == number), None).otherwise(" must be integer")
    if kind == "number":
        return F.when(t == "BIGINT", None).when(real, None).otherwise(" must be number")
    wanted = {"string": t == "STRING", "bool": t == "BOOLEAN", "array": t.startswith("ARRAY<"), "object": t.startswith("OBJECT<")}
    name = {"bool": "boolean"}.get(kind, kind)
    return F.when(~wanted[kind], f" must be {name}") if kind in wanted else None


# The kinds whose values are checked, frequent ones first.
CHECKED_KINDS = ["string", "enum", "int", "number", "bool", "array", "object"]


def _named(field: Column, problem: Column) -> Column:
    return F.concat(F.lit('field "'), field, F.lit('"'), problem)


def type_error(parsed: Column, fields: Column) -> Column:
    """Message for the first field, in name order, whose value has the wrong kind."""

    def of_field(f: Column) -> Column:
        value, problem = F.element_at(parsed, f["field"]), F.lit(None).cast("string")
        for kind in reversed(CHECKED_KINDS):
            problem = F.when(f["kind"] == kind, _problem(kind, value, f["allowed"])).otherwise(problem)
        return _named(f["field"], problem)

    return F.get(F.filter(F.transform(fields, of_field), lambda p: p.isNotNull()), F.lit(0))


def schema_error(parsed: Column, fields: Column) -> Column:
    """Both checks against an array of fields that is data (many jobs)."""
    names = F.transform(fields, lambda f: f["field"])
    return F.coalesce(key_error(parsed, names), type_error(parsed, fields))


def job_type_error(parsed: Column, job: OneJob) -> Column:
    """``type_error`` for the fields of one known job, as plain expressions."""
    found = []
    for field, kind, allowed in job.fields:
        listed = F.array(*map(F.lit, allowed or [])).cast("array<string>")
        problem = _problem(kind, F.element_at(parsed, F.lit(field)), listed)
        if problem is not None:
            found.append(_named(F.lit(field), problem))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def job_error(parsed: Column, job: OneJob) -> Column:
    """Both checks for one known job; a job without fields accepts everything."""
    if not job.fields:
        return F.lit(None).cast("string")
    names = F.array(*[F.lit(f[0]) for f in job.fields])
    return F.coalesce(key_error(parsed, names), job_type_error(parsed, job))


def check_answers(df: DataFrame, spec: DataFrame | OneJob) -> DataFrame:
    """Hold parsed answers to their job's fields; ``df`` has parsed and error.

    One known job needs no join. A compiled table of many jobs is joined on job_id:
    the fields of a job travel as one array, so an answer is checked inside its row
    and nothing is exploded; a job of very many answers is dealt over the tasks.
    """
    if isinstance(spec, OneJob):
        return df.withColumn("error", F.coalesce("error", F.when(F.col("parsed").isNotNull(), job_error(F.col("parsed"), spec))))
    with_fields = spread_join(df, spec.select(F.col("job_id").alias("_spec_job"), "fields"), "job_id", "_spec_job").drop("_spec_job")
    checked = F.when(F.col("parsed").isNotNull() & F.col("fields").isNotNull(), schema_error(F.col("parsed"), F.col("fields")))
    return with_fields.withColumn("error", F.coalesce("error", checked)).drop("fields")


# Column type of each kind of field.
KIND_TYPES = {"enum": "string", "bool": "boolean", "int": "bigint", "number": "double", "string": "string"}


def field_column(parsed: Column, field: str, kind: str) -> Column:
    """One member as a typed column; nested and free kinds stay VARIANT."""
    value = F.element_at(parsed, F.lit(field))
    return F.try_variant_get(value, "$", KIND_TYPES[kind]) if kind in KIND_TYPES else value


def spread_fields(df: DataFrame, kinds: dict[str, str], parsed: str = "parsed") -> DataFrame:
    """Members become columns and replace columns of the same name."""
    return df.withColumns({k: field_column(F.col(parsed), k, v) for k, v in sorted(kinds.items())})
