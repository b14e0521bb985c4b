"""Joins whose left side has a few very frequent keys.

A frequent-items sketch (partial per task, merged by Spark) names the keys that would fill a partition of the join. Rows of such a key
are dealt over many salts, and the few right rows of that key are repeated once per salt. All other keys are joined as
they are. This does not depend on broadcasts or on adaptive execution.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from reqweave.operators.ordering import ROW

#: A key is hot from this share of an average partition on; its rows are dealt in pieces of that size.
PIECE = 0.05
#: Keys that the sketch follows, and hot keys at most. More than ``MOST`` keys cannot each fill ``PIECE`` of a partition
#: unless there are more than ``MOST * PIECE`` partitions; then the most frequent ones are dealt.
FOLLOWED, MOST = 100_000, 10_000


def will_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate lets the frame be sent to every task."""
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def hot_keys(df: DataFrame, key: str, partitions: int | None = None) -> list[tuple[str, int]]:
    """``(key, pieces)`` of the frequent keys of a text column; nulls are no keys. One pass over that column."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = F.expr(f"approx_top_k(`{key}`, {MOST}, {FOLLOWED})")
    total, top = df.select(key).where(F.col(key).isNotNull()).agg(F.count("*"), sketch).first()
    piece = max(1.0, total / partitions * PIECE)
    return [(r["item"], math.ceil(r["count"] / piece)) for r in top if r["count"] > piece]


def _salt(df: DataFrame, pieces: Column) -> Column:
    """A piece number by the row's number, or by its place where it has none.

    Places repeat when a task is repeated as long as the order of its input does, as that of written tables.
    """
    place = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    return F.pmod(place, pieces).cast("int")


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, counted: str | None = None) -> DataFrame:
    """Left join on two text columns with hot left keys dealt over the tasks.

    ``counted`` names the column whose values are counted, where ``left_key`` holds made-up keys besides.
    """
    if will_broadcast(right):
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    hot = hot_keys(left, counted or left_key)
    if not hot:
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    spark = left.sparkSession
    dealt = F.broadcast(spark.createDataFrame(hot, "_hot_key string, _pieces int"))  # MOST rows at most
    pieces = F.coalesce("_pieces", F.lit(1))
    salted = left.join(dealt, F.col(left_key) == F.col("_hot_key"), "left")
    salted = salted.withColumn("_salt", _salt(left, pieces)).drop("_hot_key", "_pieces")
    repeated = right.join(dealt, F.col(right_key) == F.col("_hot_key"), "left")
    repeated = repeated.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_hot_key", "_pieces")
    on = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_right_salt"))
    return salted.join(repeated, on, "left").drop("_salt", "_right_salt")
