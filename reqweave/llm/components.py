"""Connected components of a table of links, by alternating stars.

Every round links each node's larger neighbours, then its smaller ones, to the smallest
node it sees; links only ever move to smaller nodes and the table ends as one star per
component. Minima are partial aggregates, so a node with very many links is combined
before it is shuffled, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqweave.storage import materialize


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``: the smallest node reachable. Links may repeat, in either direction."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(now, "links")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "links")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
