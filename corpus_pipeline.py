"""A training corpus from ``documents``: stages that each apply one operator to all their predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and works on ``docs`` alone. All but the last return rows
with the columns of ``docs``; rows with null or repeated values, empty tables and extra columns are handled
as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqweave.llm.common import start, table
from reqweave.llm.crf import fitted, recognised
from reqweave.llm.mixing import mixed
from reqweave.llm.packing import pack
from reqweave.llm.queries import word_tokenizer
from reqweave.llm.secrets import redact
from reqweave.llm.superminhash import first_of_groups
from reqweave.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognised language go; the others carry the predicted one."""
    start(spark)
    return recognised(docs, fitted(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    start(spark)
    return first_of_groups(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    start(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights."""
    start(spark)
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece."""
    start(spark)
    return pack(docs, word_tokenizer())


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("secret scans", secrets), ("mixing sources", mix), ("packing", packed)]

#: Language, signatures and tokens have no SQL form; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
