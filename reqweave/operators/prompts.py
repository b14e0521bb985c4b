"""Record to request text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reqweave.functions.jsonvals import (
    float_text, framed, framed_value, input_payload, is_nested, pretty_record, reindent, value_json, value_kind,
)
from reqweave.functions.text import trim_space
from reqweave.operators.ordering import ROW

# Fixed value: what a missing or null field shows as.
NO_VALUE = "<no value>"
_SLOT = re.compile(r"\{\{-?\s*(?:(toPrettyJSON)\s+)?\.(\w+)\s*-?\}\}")


@dataclass(frozen=True)
class Template:
    """Literals and slots; ``pieces`` alternates text and (field, as_json)."""

    pieces: tuple

    @staticmethod
    def compile(source: str) -> "Template":
        pieces, at = [], 0
        for slot in _SLOT.finditer(source):
            pieces.append(source[at : slot.start()])
            pieces.append((slot.group(2), bool(slot.group(1))))
            at = slot.end()
        pieces.append(source[at:])
        if any("{{" in p for p in pieces[::2]):
            raise ValueError("templates hold {{ .field }} and {{ toPrettyJSON .record }} only")
        return Template(tuple(pieces))

    @property
    def literal_start(self) -> str:
        return self.pieces[0].lstrip()

    @property
    def is_whole_record(self) -> bool:
        texts = [p for p in self.pieces[::2] if p.strip()]
        return not texts and self.pieces[1::2] == (("record", True),)


def whole_record(df: DataFrame) -> Column:
    """All columns of the record as indented JSON, its number left out."""
    return pretty_record(df, [c for c in df.columns if c != ROW])


def _slot_text(df: DataFrame, field: str, as_json: bool) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    if field == "record" and field not in types:
        return whole_record(df)
    if field not in types:
        return F.lit("null" if as_json else NO_VALUE)
    c, dtype = F.col(f"`{field}`"), types[field]
    if as_json:
        text = value_json(c, dtype)
        return reindent(text) if is_nested(dtype) else text
    if dtype.typeName() in ("double", "float"):
        text = float_text(c.cast("double"), -4, 6, pad_small=True)
    elif is_nested(dtype):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NO_VALUE))


def render_template(df: DataFrame, source: str) -> Column:
    """Template text per record, compiled once into one concatenation."""
    t = Template.compile(source)
    parts = [F.lit(p) if isinstance(p, str) else _slot_text(df, *p) for p in t.pieces if p != ""]
    return F.concat(*parts) if parts else F.lit("")


# Fixed value: first characters of a JSON text.
_JSON_START = set('{["-0123456789tfn')


def record_body(df: DataFrame, source: str, out: str = "_body") -> DataFrame:
    """Rendered template as a JSON payload.

    Blank gives the whole record, a JSON object or array is re-indented, anything
    else is wrapped. What the template can produce is decided here, so that the
    Arrow function only runs for templates that may render JSON of their own.
    """
    t = Template.compile(source)
    if t.is_whole_record or not source.strip():
        return df.withColumn(out, whole_record(df))
    rendered = render_template(df, source)
    if t.literal_start and t.literal_start[0] not in _JSON_START:
        return df.withColumn(out, input_payload(rendered))
    return (
        df.withColumn("_text", trim_space(rendered))
        .withColumn("_frame", framed(F.col("_text")))
        .withColumn("_kind", value_kind(framed_value(F.col("_frame"))))
        .withColumn("_nested", reindent(F.when(F.col("_kind").isin("object", "array"), F.col("_text"))))
        .withColumn(
            out,
            F.when(F.col("_text") == "", whole_record(df))
            .when(F.col("_nested").isNotNull(), F.col("_nested"))
            .when(F.col("_kind").isNotNull(), F.concat(F.lit('{\n  "input": '), F.col("_text"), F.lit("\n}")))
            .otherwise(input_payload(F.col("_text"))),
        )
        .drop("_text", "_frame", "_kind", "_nested")
    )


def user_text(body: Column, pre: str = "", post: str = "", instructions: Column | None = None) -> Column:
    """Prompt parts with blank lines between them; empty parts are left out."""
    parts = [F.lit(pre)] if pre else []
    parts.append(body)
    if post:
        parts.append(F.lit(post))
    if instructions is not None:
        parts.append(F.nullif(instructions, F.lit("")))
    return F.concat_ws("\n\n", *parts)


def request_id(run: str, index: str, system: str, user: str) -> Column:
    """Stable id of one request; a restart finds its stored answer again."""
    return F.sha2(F.concat_ws("\x1f", F.lit(run), F.col(index).cast("string"), F.col(system), F.col(user)), 256)
