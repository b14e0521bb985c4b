"""Raking of token weights to source, language and topic targets, and sampling by the result.

Documents are counted into cells of (source, language, topic). Iterative proportional
fitting scales the cells' token weights to the targets of one dimension after the other;
no cell may pass what it can supply at the wanted share of tokens, so that a weight is
always a probability of at most 1. A document is sampled when a uniform number made from
its id lies below its cell's probability, so a run can be repeated and the choice does not
depend on partitions.

Everything here is DataFrame operations. Cells and marginals are aggregates (combined before
they are shuffled); a source that holds a third of all rows is one row of them. Each sweep is
written, so its plan does not grow and lost executors repeat one sweep at most.

Edge cases: a null source or language is the category ``(none)``; a null text counts as
empty, with topic ``prose`` and no tokens. A cell without tokens has probability 0. Rows with
equal ids share one uniform number (null ids: one from their text). Empty tables give empty
tables. Extra columns are kept by ``mixed``; helper columns are named apart from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqweave.storage import materialize

#: Topics by the first pattern that a text matches; all others are prose.
TOPICS = (("legal", "[Ll]icense|[Cc]opyright"), ("contact", "[0-9a-z]@[0-9a-z]"), ("figures", "[0-9]{6}"))
NONE = "(none)"
#: Targets are observed shares to this power, so that small categories gain.
TEMPERATURE = 0.7
#: Share of all tokens that the sample should hold.
SHARE = 0.5
SWEEPS = 6
DIMENSIONS = ("source", "lang", "topic")
_CELL = ("_mix_source", "_mix_lang", "_mix_topic")


def topic_of(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("prose"))


def tokens_of(text: Column) -> Column:
    """Four bytes a token, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    key = F.coalesce(doc_id.cast("string"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_cells(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    named = {"_mix_source": F.coalesce(F.col(source_col), F.lit(NONE)), "_mix_lang": F.coalesce(F.col(lang_col), F.lit(NONE))}
    named["_mix_topic"] = F.coalesce(topic_of(F.col(text_col)), F.lit("prose"))
    return docs.withColumns({**named, "_mix_tokens": tokens_of(F.col(text_col))})


def targets(cells: DataFrame, column: str, total: float, temperature: float) -> DataFrame:
    """``column, target``: the shares of a dimension's categories, flattened, as tokens."""
    marginal = cells.groupBy(column).agg((F.sum("_mix_supply") / total).alias("part"))
    raised = marginal.select(column, F.pow("part", F.lit(temperature)).alias("part"))
    scale = raised.agg(F.sum("part")).first()[0]
    return raised.select(column, (F.col("part") * (total / scale)).alias("_mix_target"))


def rake(cells: DataFrame, temperature: float = TEMPERATURE, share: float = SHARE, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with ``_mix_weight`` (raked tokens of the whole) and ``_mix_probability``."""
    total = cells.agg(F.sum("_mix_supply")).first()[0]
    if not total:
        return cells.withColumns({"_mix_weight": F.lit(0.0), "_mix_probability": F.lit(0.0)})
    wanted = {column: materialize(targets(cells, column, float(total), temperature), "targets") for column in _CELL}
    now = cells.withColumn("_mix_weight", F.col("_mix_supply").cast("double"))
    for _ in range(sweeps):
        for column in _CELL:
            sums = now.groupBy(column).agg(F.sum("_mix_weight").alias("_mix_sum")).join(wanted[column], column)
            scaled = F.when(F.col("_mix_sum") > 0, F.col("_mix_weight") * F.col("_mix_target") / F.col("_mix_sum")).otherwise(0.0)
            now = now.join(sums, column).withColumn("_mix_weight", F.least(scaled, F.col("_mix_supply") / share)).drop("_mix_sum", "_mix_target")
        now = materialize(now, "sweep")
    probability = F.when(F.col("_mix_supply") > 0, F.least(F.lit(1.0), F.col("_mix_weight") * share / F.col("_mix_supply"))).otherwise(0.0)
    return now.withColumn("_mix_probability", probability)


def calibrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` with their cell, tokens, probability and whether they are sampled."""
    placed = with_cells(docs, text_col, source_col, lang_col)
    cells = materialize(placed.groupBy(*_CELL).agg(F.sum("_mix_tokens").alias("_mix_supply")), "cells")
    raked = materialize(rake(cells, **options).select(*_CELL, "_mix_probability"), "raked")
    found = placed.join(raked, list(_CELL))
    return found.withColumn("_mix_sampled", uniform(F.col(id_col), F.col(text_col)) < F.col("_mix_probability"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns."""
    return calibrated(docs, **options).where("_mix_sampled").select(*[F.col(c) for c in docs.columns])


def sampling_report(docs: DataFrame, **options) -> DataFrame:
    """Every document with its cell, tokens, probability and the decision."""
    return calibrated(docs, **options).select(
        "doc_id", *[F.col(c).alias(d) for c, d in zip(_CELL, DIMENSIONS, strict=True)], F.col("_mix_tokens").alias("tokens"),
        F.round("_mix_probability", 6).alias("probability"), F.col("_mix_sampled").alias("sampled"),
    )


def report_sql(temperature: float = TEMPERATURE, share: float = SHARE, sweeps: int = SWEEPS) -> str:
    """The same report in SQL over ``documents``."""
    cases = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps, last = [], "w0"
    for k in range(sweeps * len(DIMENSIONS)):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        scaled = f"CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * target / sum(weight) OVER (PARTITION BY {d}) ELSE 0.0 END"
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, supply, least({scaled}, supply / {share}) AS weight FROM {last} JOIN t_{d} USING ({d}))")
        last = f"w{k + 1}"
    goals = ", ".join(
        f"t_{d} AS MATERIALIZED (SELECT {d}, part * (SELECT sum(supply) FROM cells) / sum(part) OVER () AS target FROM "
        f"(SELECT {d}, pow(sum(supply) / (SELECT sum(supply) FROM cells), {temperature}) AS part FROM cells GROUP BY {d}))" for d in DIMENSIONS
    )
    return f"""WITH placed AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {cases} ELSE 'prose' END AS topic,
         CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS supply FROM placed GROUP BY ALL),
{goals},
w0 AS (SELECT source, lang, topic, supply, supply AS weight FROM cells),
{", ".join(steps)},
p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN supply > 0 THEN least(1.0, weight * {share} / supply) ELSE 0.0 END AS probability FROM {last})
SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, u < probability AS sampled FROM placed JOIN p USING (source, lang, topic)"""
