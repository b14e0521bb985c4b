"""Text functions, all built from JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from reqweave.functions.patterns import compiled, translated

# The code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Marks of the text functions.
PAGE_MARK = "... [truncated]"
LOOKUP_MARK = "…"
CLOSE_THINKING = "</thinking>"


def trim_space(c: Column) -> Column:
    """Strip Unicode white space on both sides (``trim`` only strips blanks)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for null and for text made of white space only."""
    return F.coalesce(trim_space(c), F.lit("")) == ""


def is_empty_value(c: Column, dtype: T.DataType) -> Column:
    """A cell counts as empty when null, or when blank text, also as text inside a VARIANT."""
    if isinstance(dtype, T.VariantType):
        return c.isNull() | ((F.schema_of_variant(c) == "STRING") & is_blank(F.try_variant_get(c, "$", "string")))
    return is_blank(c) if isinstance(dtype, T.StringType) else c.isNull()


def text_stats(c: Column) -> Column:
    """Counts over one text; null for blank text, which has no statistics."""
    trimmed = trim_space(c)
    newlines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    words = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    filled = F.size(F.filter(F.split(c, "\n"), lambda line: trim_space(line) != ""))
    return F.when(
        trimmed != "",
        F.struct(
            F.octet_length(c).alias("bytes"),
            F.char_length(c).alias("characters"),
            (newlines + F.when(F.endswith(c, F.lit("\n")), 0).otherwise(1)).alias("lines"),
            filled.alias("paragraphs"),
            trimmed.alias("trimmed"),
            words.alias("words"),
        ),
    )


def first_of(found: Column, limit: int = 0) -> Column:
    """The first ``limit`` items of an array; 0 means all."""
    return F.slice(found, 1, limit) if limit > 0 else found


def regex_extract(
    text: Column, pattern: str, group: int = 0, max_matches: int = 0, case_insensitive: bool = False
) -> Column:
    """Matches of one fixed pattern: struct of pattern, group, count, matches, truncated.

    All matches, or the first ``max_matches``. The pattern is checked and translated on
    the driver. A group the pattern does not have gives no matches. Patterns that can
    match nothing at all are refused here, because Java counts empty matches
    differently; the per-row tool handles those.
    """
    source = pattern.strip()
    if not source:
        raise ValueError("pattern is required")
    if compiled(source).match("") is not None:
        raise ValueError("a pattern that matches empty text needs the per-row regex tool")
    java, groups = translated(source, True, case_insensitive)
    group = max(group, 0)
    if group > groups:
        found = F.array().cast("array<string>")
    else:
        found = first_of(F.regexp_extract_all(text, F.lit(java), F.lit(group)), max_matches)
    cut = F.size(found) >= max_matches if max_matches > 0 else F.lit(False)
    return F.when(
        ~is_blank(text),
        F.struct(
            F.size(found).alias("count"),
            F.lit(group).alias("group"),
            found.alias("matches"),
            F.lit(pattern).alias("pattern"),
            cut.alias("truncated"),
        ),
    )


def strip_tags(html: Column, drop_code: bool = False) -> Column:
    """Tags become blanks, white space collapses. Script and style text stays
    unless ``drop_code`` is set."""
    if drop_code:
        html = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    flat = F.regexp_replace(html, "<[^>]+>", " ")
    return trim_space(F.regexp_replace(flat, r"[\t\n\f\r ]+", " "))


def html_to_text(html: Column, limit: int = 0, drop_code: bool = False) -> Column:
    return truncate_text(strip_tags(html, drop_code), limit, PAGE_MARK)


def truncate_text(c: Column, limit: int = 0, mark: str = LOOKUP_MARK) -> Column:
    """Cut after ``limit`` characters and show that something was cut; 0 means whole texts."""
    if limit <= 0:
        return c
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def strip_thinking(c: Column) -> Column:
    """Text after the first closing thinking tag, or all of it."""
    t = trim_space(c)
    at = F.locate(CLOSE_THINKING, t)
    rest = F.substring(t, at + len(CLOSE_THINKING), F.length(t))
    return F.when(at > 0, trim_space(rest)).otherwise(t)


def sanitize_name(c: Column) -> Column:
    """A valid XML element name; every other character becomes an underscore."""
    safe = F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")
    safe = F.regexp_replace(safe, "^[0-9.-]", "_")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("_")).otherwise(safe)


def render_search_result(query: Column, answer: Column, abstract: Column, source: Column, topics: Column, most_topics: int = 0) -> Column:
    """Stored search answer as text; ``topics`` is ARRAY<STRUCT<text, url>>, shown all or the first ``most_topics``."""
    lines = F.transform(
        F.filter(first_of(topics, most_topics), lambda t: F.coalesce(t["text"], F.lit("")) != ""),
        lambda t: F.concat(
            F.lit("- "), t["text"],
            F.when(F.coalesce(t["url"], F.lit("")) != "", F.concat(F.lit("\n  "), t["url"])).otherwise(""),
        ),
    )
    shown_source = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("\nSource: "), source)).otherwise("")
    parts = F.array(
        F.when(F.coalesce(answer, F.lit("")) != "", F.concat(F.lit("Answer: "), answer)),
        F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(F.lit("Summary: "), abstract, shown_source)),
        F.when(F.size(lines) > 0, F.array_join(lines, "\n")),
    )
    text = trim_space(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n"))
    return F.when(text == "", F.concat(F.lit("No results found for: "), query)).otherwise(text)
