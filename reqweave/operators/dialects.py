"""Request bodies and answer envelopes of the provider dialects."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reqweave.functions.binding import let
from reqweave.functions.jsonvals import escape_markup
from reqweave.functions.text import trim_space

# Dialect names, default limit and cache mark of the wire formats.
DIALECTS = ["chat", "azure", "messages", "generate_content", "generate", "responses"]
MESSAGES_LIMIT = 1024
CACHE_MARK = "ephemeral"


def _text_struct(**members: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in members.items()])


def build_request_payload(
    dialect: str, system: Column, user: Column, model: str, max_tokens: int = 0, cache: bool = False
) -> Column:
    """JSON request body; members that are not set are left out."""
    has_system = F.coalesce(system, F.lit("")) != ""
    given = F.when(has_system, system)
    limit = F.lit(max_tokens if max_tokens > 0 else None).cast("long")
    if dialect in ("chat", "azure"):
        turn = _text_struct(role=F.lit("user"), content=user)
        lead = _text_struct(role=F.lit("system"), content=system)
        named = F.lit(None if dialect == "azure" else model).cast("string")
        body = _text_struct(model=named, messages=F.when(has_system, F.array(lead, turn)).otherwise(F.array(turn)), max_tokens=limit)
    elif dialect == "messages":
        turn = _text_struct(role=F.lit("user"), content=user)
        blocks = F.array(_text_struct(type=F.lit("text"), text=system, cache_control=_text_struct(type=F.lit(CACHE_MARK))))
        # the system member is present even when empty, unless it carries a cache mark
        head = F.when(has_system, blocks) if cache else F.coalesce(system, F.lit(""))
        body = _text_struct(
            model=F.lit(model), system=head, messages=F.array(turn),
            max_tokens=F.lit(max_tokens if max_tokens > 0 else MESSAGES_LIMIT).cast("long"),
        )
        if cache:
            plain = _text_struct(model=F.lit(model), system=F.lit(""), messages=F.array(turn), max_tokens=body["max_tokens"])
            return escape_markup(F.when(has_system, F.to_json(body)).otherwise(F.to_json(plain)))
    elif dialect == "generate_content":
        parts = lambda c: F.array(_text_struct(text=c))
        body = _text_struct(
            system_instruction=F.when(has_system, _text_struct(parts=parts(system))),
            contents=F.array(_text_struct(role=F.lit("user"), parts=parts(user))),
            generation_config=F.when(limit.isNotNull(), _text_struct(maxOutputTokens=limit)),
        )
    elif dialect == "generate":
        body = _text_struct(model=F.lit(model), prompt=user, system=given, stream=F.lit(False))
    elif dialect == "responses":
        body = _text_struct(model=F.lit(model), instructions=given, input=user, max_output_tokens=limit)
    else:
        raise ValueError(f"unknown dialect {dialect!r}, expected one of {DIALECTS}")
    return escape_markup(F.to_json(body))


_CALLS = "tool_calls ARRAY<STRUCT<id STRING, function STRUCT<name STRING, arguments STRING>>>"
ENVELOPES = {
    "chat": f"choices ARRAY<STRUCT<message STRUCT<content STRING, {_CALLS}>>>, error STRUCT<message STRING, type STRING>",
    "messages": "content ARRAY<STRUCT<type STRING, text STRING, id STRING, name STRING, input STRING>>, error STRUCT<message STRING, type STRING>",
    "generate_content": "candidates ARRAY<STRUCT<content STRUCT<parts ARRAY<STRUCT<text STRING>>>>>, error STRUCT<message STRING, code INT>",
    "generate": "response STRING, error STRING",
    "responses": "output_text STRING, error STRUCT<message STRING, type STRING>",
}
# How each dialect names itself in an error, and what it says about an empty envelope.
PROVIDERS = {"chat": "", "messages": "anthropic", "generate_content": "gemini", "generate": "ollama", "responses": ""}
NO_TEXT = {
    "chat": "no content in response", "messages": "no text content returned by anthropic",
    "generate_content": "no content returned by gemini",
}
NO_CHOICES = "no choices returned by api"
UNREADABLE = "decode response"


def _reported(dialect: str, e: Column) -> Column:
    who = (PROVIDERS[dialect] + " api error").strip()
    if dialect == "generate":
        return F.when(F.coalesce(e["error"], F.lit("")) != "", F.concat(F.lit(who + ": "), trim_space(e["error"])))
    message = trim_space(F.coalesce(e["error"]["message"], F.lit("")))
    if dialect == "generate_content":
        return F.when(e["error"].isNotNull(), F.concat(F.lit(who + ": "), message))
    kind = trim_space(F.coalesce(e["error"]["type"], F.lit("")))
    shown = F.when(kind != "", F.concat(F.lit(who + " ("), kind, F.lit("): "), message)).otherwise(F.concat(F.lit(who + ": "), message))
    return F.when(e["error"].isNotNull(), shown)


def extract_response_text(dialect: str, body: Column) -> Column:
    """struct(text, error) from a provider envelope."""
    dialect = "chat" if dialect == "azure" else dialect
    # the two readings are bound, because everything below looks at them many times
    read = lambda b: F.struct(F.from_json(b, ENVELOPES[dialect]).alias("e"), F.try_parse_json(b).isNotNull().alias("readable"))
    return let(body, lambda b: let(read(b), lambda r: _said(dialect, r["e"], r["readable"])))


def _said(dialect: str, e: Column, readable: Column) -> Column:
    empty = F.lit(None).cast("string")
    if dialect == "chat":
        text = F.get(e["choices"], F.lit(0))["message"]["content"]
        empty = F.when(F.coalesce(F.size(e["choices"]), F.lit(0)) <= 0, NO_CHOICES)
    elif dialect == "messages":
        text = F.get(F.filter(e["content"], lambda b: b["type"] == "text"), F.lit(0))["text"]
    elif dialect == "generate_content":
        text = F.get(F.get(e["candidates"], F.lit(0))["content"]["parts"], F.lit(0))["text"]
    elif dialect == "generate":
        text = F.coalesce(e["response"], F.lit(""))
    else:
        text = F.coalesce(e["output_text"], F.lit(""))
    missing = F.when(text.isNull(), F.lit(NO_TEXT.get(dialect)))
    error = F.when(~readable, UNREADABLE).otherwise(F.coalesce(_reported(dialect, e), empty, missing))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def extract_tool_calls(dialect: str, body: Column) -> Column:
    """struct(content, calls) of an envelope that may ask for tools."""
    return let(F.from_json(body, ENVELOPES["chat" if dialect == "azure" else dialect]), lambda e: _asked(dialect, e))


def _asked(dialect: str, e: Column) -> Column:
    if dialect == "messages":
        asked = F.filter(e["content"], lambda b: b["type"] == "tool_use")
        calls = F.transform(asked, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("args")))
        said = F.transform(F.filter(e["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
        return F.struct(F.array_join(said, "").alias("content"), calls.alias("calls"))
    message = F.get(e["choices"], F.lit(0))["message"]
    none = F.array().cast("array<struct<id:string,name:string,args:string>>")
    calls = F.coalesce(
        F.transform(
            message["tool_calls"],
            lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("args")),
        ),
        none,
    )
    content = F.when(F.size(calls) > 0, "").otherwise(F.coalesce(message["content"], F.lit("")))
    return F.struct(content.alias("content"), calls.alias("calls"))
