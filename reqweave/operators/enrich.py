"""Looking up one text per record in a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqweave.functions.text import strip_tags, trim_space, truncate_text
from reqweave.operators.hotkeys import spread_join


# Key of rows that must not match: no stored key starts so, for keys are trimmed texts of records and addresses.
NO_KEY = "\x00no key "


def spread_key(key: Column) -> Column:
    """A join key whose nulls are spread over many values, so that rows without a key do not meet in one task."""
    return F.coalesce(key, F.concat(F.lit(NO_KEY), F.monotonically_increasing_id().cast("string")))


def enrich_lookup(
    df: DataFrame, column: str, lookup: DataFrame, key: str, result: str,
    output_field: str = "", max_chars: int = 0,
) -> DataFrame:
    """Adds the looked-up text of ``column``.

    A blank key leaves the field null, a key without a hit gives empty text. The
    lookup side is reduced to one row per key before it is joined; whether it is
    broadcast is left to Spark, which knows its size. In a shuffled join popular keys are dealt over the
    tasks, and blank keys, which never match, are spread. ``max_chars`` 0 keeps whole texts.
    """
    out = output_field or f"enriched_{column}"
    source = F.col(f"`{column}`")
    asked = F.nullif(trim_space(source.cast("string")), F.lit(""))
    answers = (
        lookup.select(trim_space(F.col(key).cast("string")).alias("_key"), F.col(result).cast("string").alias("_hit"))
        .groupBy("_key").agg(F.min("_hit").alias("_hit"))
    )
    keyed = df.withColumn("_asked", asked).withColumn("_asked_key", spread_key(F.col("_asked")))
    found = spread_join(keyed, answers, "_asked_key", "_key", "_asked")
    value = F.when(F.col("_asked").isNotNull(), truncate_text(F.coalesce("_hit", F.lit("")), max_chars))
    return found.withColumn(out, value).drop("_asked", "_asked_key", "_key", "_hit")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_link(topics: Column) -> Column:
    """Address of the first topic that has an http one; topics ARRAY<STRUCT<text, url>>."""
    return F.get(F.filter(topics, lambda t: t["url"].startswith("http")), F.lit(0))["url"]


def wanted_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``(_page, _html)``: one stored page per address in ``links(link)``.

    Pages nobody asked for are dropped by a semi join before any page text is
    grouped, so what is shuffled grows with the requests, not with the page store.
    """
    asked = links.where(F.col("link").isNotNull()).distinct()
    kept = pages.join(asked, pages["url"] == asked["link"], "left_semi")
    return kept.groupBy(F.col("url").alias("_page")).agg(F.min("html").alias("_html"))


def answer_precedence(answers: DataFrame, pages: DataFrame) -> DataFrame:
    """``answers(query, abstract, answer, topics)`` to ``(query, result)``.

    Abstract (after the answer, if both exist), else answer, else the text of the
    first related page stored in ``pages(url, html)``, else empty text.
    """
    abstract, answer = _filled(F.col("abstract")), _filled(F.col("answer"))
    direct = F.coalesce(F.concat(answer, F.lit("\n\n"), abstract), abstract, answer)
    wanted = answers.withColumn("_direct", direct).withColumn(
        "_link", F.when(F.col("_direct").isNull(), first_link(F.col("topics")))
    )
    texts = wanted_pages(pages, wanted.select(F.col("_link").alias("link")))
    found = spread_join(wanted.withColumn("_link_key", spread_key(F.col("_link"))), texts, "_link_key", "_page", "_link")
    return found.select("query", F.coalesce("_direct", strip_tags(F.col("_html")), F.lit("")).alias("result"))
