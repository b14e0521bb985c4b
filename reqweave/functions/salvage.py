"""Finding JSON inside mixed text. Scanning braces needs a cursor, so these are
Arrow-batched functions over whole texts; everything else stays in the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def last_object(text: str | None) -> str | None:
    """Shortest ending of the text up to its last brace that is one JSON object."""
    if text is None:
        return None
    end = text.rfind("}")
    start = text.rfind("{", 0, end) if end > 0 else -1
    while start >= 0:
        try:
            if _DECODER.raw_decode(text, start)[1] == end + 1:
                return text[start : end + 1]
        except (ValueError, RecursionError):
            pass
        start = text.rfind("{", 0, start)
    return None


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]|"', re.DOTALL)


def first_object(text: str | None) -> str | None:
    """First balanced ``{..}``; braces inside strings do not count."""
    if text is None:
        return None
    start = text.find("{")
    depth = 0
    for token in _TOKENS.finditer(text, max(start, 0)) if start >= 0 else ():
        mark = token.group()
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0:
                return text[start : token.end()]
        elif mark == '"':
            return None
    return None


_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.DOTALL)
_RAW = re.compile(r"\\.|\r\n|[\x00-\x1f]", re.DOTALL)


def _raw_escape(found: re.Match) -> str:
    mark = found.group()
    if mark.startswith("\\"):
        return mark
    if mark in ("\r\n", "\r", "\n"):
        return "\\n"
    return "\\t" if mark == "\t" else f"\\u{ord(mark):04x}"


def escape_controls(text: str | None) -> str | None:
    """Escape raw control characters inside JSON strings."""
    if text is None:
        return None
    return _STRINGS.sub(lambda s: _RAW.sub(_raw_escape, s.group()), text)


@F.pandas_udf(T.StringType())
def extract_last_json(texts: pd.Series) -> pd.Series:
    return texts.map(last_object, na_action="ignore")


@F.pandas_udf(T.StringType())
def extract_first_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_object, na_action="ignore")


@F.pandas_udf(T.StringType())
def escape_control_chars(texts: pd.Series) -> pd.Series:
    return texts.map(escape_controls, na_action="ignore")
