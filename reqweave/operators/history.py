"""Run log and reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reqweave.functions.text import trim_space


def run_history(runs: DataFrame, limit: int = 0, show_archived: bool = False) -> DataFrame:
    """Newest runs first, all or ``limit``. The limit counts archived runs too, then hides them."""
    newest = runs.orderBy(F.desc("run_id"))
    newest = newest.limit(limit) if limit > 0 else newest
    return newest if show_archived else newest.where(~F.col("archived"))


def clean_reference_table(df: DataFrame, order: str) -> DataFrame:
    """``df(id, label, provider, model, ..)``: trimmed texts, provider in lower case,
    incomplete rows dropped, the first row of each id kept, label defaults to id."""
    texts = [c for c, t in df.dtypes if t == "string"]
    clean = df.withColumns({c: trim_space(F.coalesce(F.col(c), F.lit(""))) for c in texts})
    clean = clean.withColumn("provider", F.lower("provider"))
    full = clean.where((F.col("id") != "") & (F.col("provider") != "") & (F.col("model") != ""))
    others = [c for c in df.columns if c != "id"]
    # min_by keeps one row per id before the shuffle, so a frequent id is no hot spot
    first = full.groupBy("id").agg(F.min_by(F.struct(*others), F.col(order)).alias("_first")).select("id", "_first.*")
    return first.withColumn("label", F.when(F.col("label") == "", F.col("id")).otherwise(F.col("label"))).select(*df.columns)
