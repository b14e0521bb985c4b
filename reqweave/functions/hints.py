"""Free-text type hints of answer fields, read with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqweave.functions.text import trim_space

# Words that name a kind, in the order in which they are tried.
KIND_WORDS = [
    ("bool", ["bool", "boolean"]),
    ("int", ["int", "integer", "int32", "int64"]),
    ("number", ["number", "float", "double", "decimal"]),
    ("string", ["string", "str", "text"]),
    ("array", ["array", "list", "slice"]),
    ("object", ["object", "map", "json"]),
]
# How a kind is described in a prompt and shown in an example.
KIND_TEXT = {
    "bool": "boolean (true or false)",
    "int": "integer",
    "number": "number",
    "string": "string",
    "array": "array",
    "object": "object",
}
KIND_EXAMPLE = {"bool": "true", "int": "0", "number": "0.0", "array": "[]", "object": "{}"}
EXAMPLE_TEXT = '"<value>"'
ENUM_TEXT = "string — exactly one of: "
FREE_TEXT = "string — "
ONE_OF = "one of"


def word_kind(hint: Column) -> Column:
    """Kind by the words of the hint, ``any`` when none is known."""
    lowered = F.lower(hint)
    kind = F.lit("any")
    for name, known in reversed(KIND_WORDS):
        kind = F.when(lowered.rlike(f"(?<![a-z0-9])({'|'.join(known)})(?![a-z0-9])"), name).otherwise(kind)
    return kind


def _after_one_of(hint: Column) -> Column:
    at = F.locate(ONE_OF, F.lower(hint))
    rest = trim_space(F.substring(hint, at + len(ONE_OF), F.length(hint)))
    return F.when(at > 0, F.ltrim(rest, F.lit(": ")))


def _split_on(text: Column, sep: str) -> Column:
    return F.split(text, "[" + sep + "]")


def _two_or_more(values: Column) -> Column:
    return F.when(F.size(values) >= 2, values)


def _allowed(parts: Column) -> Column:
    bare = F.transform(parts, lambda p: trim_space(F.btrim(trim_space(p), F.lit("\"'"))))
    return _two_or_more(F.array_distinct(F.filter(bare, lambda p: p != "")))


def parse_enum(hint: Column) -> Column:
    """Allowed values of an enum hint in the order written, else null."""
    h = trim_space(hint)
    rest = _after_one_of(h)
    listed = (
        F.when(F.contains(rest, F.lit(",")), _allowed(_split_on(rest, ",")))
        .when(F.contains(rest, F.lit("|")), _allowed(_split_on(rest, "|")))
        .when(F.contains(rest, F.lit("/")), _allowed(_split_on(rest, "/")))
    )
    return F.coalesce(F.when(F.contains(h, F.lit("|")), _allowed(_split_on(h, "|"))), listed)


def infer_kind(hint: Column, allowed: Column | None = None) -> Column:
    """Kind of a hint; ``allowed`` is its parsed enum, if that is at hand."""
    h = trim_space(F.coalesce(hint, F.lit("")))
    allowed = parse_enum(h) if allowed is None else allowed
    return F.when(h == "", "any").when(allowed.isNotNull(), "enum").otherwise(word_kind(h))


def _spelled(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim_space), lambda p: p != "")


def _one_of_parts(rest: Column) -> Column:
    by_pipe = ~F.contains(rest, F.lit(",")) & F.contains(rest, F.lit("|"))
    return F.when(by_pipe, _split_on(rest, "|")).otherwise(_split_on(rest, ","))


def describe_hint(hint: Column) -> Column:
    """Plain-English text of a hint for the prompt."""
    h = trim_space(F.coalesce(hint, F.lit("")))
    rest = _after_one_of(h)
    choices = F.coalesce(
        F.when(F.contains(h, F.lit("|")), _two_or_more(_spelled(_split_on(h, "|")))),
        F.when(rest != "", _two_or_more(_spelled(_one_of_parts(rest)))),
    )
    as_list = F.array_join(F.transform(choices, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    kind = word_kind(h)
    scalar = F.concat(F.lit(FREE_TEXT), h)
    for name, text in KIND_TEXT.items():
        scalar = F.when(kind == name, text).otherwise(scalar)
    return (
        F.when(h == "", "string")
        .when(choices.isNotNull(), F.concat(F.lit(ENUM_TEXT), as_list))
        .otherwise(scalar)
    )


def example_value(hint: Column) -> Column:
    """JSON text of a value of the hinted kind, shown in the prompt."""
    h = trim_space(F.coalesce(hint, F.lit("")))
    rest = _after_one_of(h)
    first = F.coalesce(
        F.when(F.contains(h, F.lit("|")), F.nullif(trim_space(_split_on(h, "|")[0]), F.lit(""))),
        F.when(rest.isNotNull(), F.nullif(trim_space(_one_of_parts(rest)[0]), F.lit(""))),
    )
    kind = word_kind(h)
    scalar = F.lit(EXAMPLE_TEXT)
    for name, text in KIND_EXAMPLE.items():
        scalar = F.when(kind == name, text).otherwise(scalar)
    return F.when(first.isNotNull(), F.concat(F.lit('"'), first, F.lit('"'))).otherwise(scalar)


# Dry-run values; each passes the check of its own kind.
DRY_TEXT = "[dry-run]"
DRY_VALUES = {"bool": "false", "int": "0", "number": "0", "array": "[]", "object": "{}"}


def placeholder_value(kind: Column, allowed: Column) -> Column:
    """JSON text of a dry-run value that satisfies the kind."""
    text = F.lit(f'"{DRY_TEXT}"')
    for name, value in DRY_VALUES.items():
        text = F.when(kind == name, value).otherwise(text)
    first = F.to_json(F.slice(allowed, 1, 1))
    return F.when(kind == "enum", F.substring(first, F.lit(2), F.length(first) - 2)).otherwise(text)
