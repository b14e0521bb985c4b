"""Records from a database through JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, query: str = "", table: str = "", partition: dict | None = None, **extra) -> dict[str, str]:
    """Reader options. A query is read by one task; a table with a numeric
    partition column (column, lower, upper, parts) by many."""
    if not url.strip():
        raise ValueError("missing connection url")
    if bool(query.strip()) == bool(table.strip()):
        raise ValueError("give either a query or a table")
    options = {"url": url, **({"query": query} if query.strip() else {"dbtable": table})}
    if partition:
        if query.strip():
            raise ValueError("a partitioned read needs a table")
        options |= {
            "partitionColumn": partition["column"], "lowerBound": str(partition["lower"]),
            "upperBound": str(partition["upper"]), "numPartitions": str(partition["parts"]),
        }
    return options | {k: str(v) for k, v in extra.items()}


def scan_sql(spark: SparkSession, url: str, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, **kwargs)).load()
