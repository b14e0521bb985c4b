"""Calls in rounds: a request that fails waits for its next attempt in a table, not inside a task.

Each round sends every request whose time has come, once, and is written. What failed and has attempts left
carries the time of its next one (``release_at``, seconds since 1970); the driver waits for the earliest. So a failing
request holds up no other, a task never sleeps out a back-off, and with a folder the attempts made survive a restart.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reqweave.operators.generate import Generator, _wait, call_pause
from reqweave.operators.retry import MAX_ATTEMPTS
from reqweave.storage import new_folder

TRY = "response string, error string, duration_ms long, wait double, asked boolean"
#: Error of requests that a stopped task did not send any more.
NOT_ASKED = "not asked: an earlier request failed"
#: Requests whose time comes this soon after the earliest go in the same round (seconds).
SLACK = 0.5
#: What a round keeps of a request that an earlier run has sent.
PRIOR = ("response", "attempts", "duration_ms")


def try_once(
    fn: Generator, system: Column, user: Column, attempts: Column, last: int, stop: bool = False, sleep=time.sleep, pause: float = 0.0
) -> Column:
    """One attempt per row: answer or error, and the seconds to wait before the next one.

    ``attempts`` counts those made before; a row with a null user text is not sent. With ``stop`` a task sends nothing
    more after the last attempt of a request has failed.
    """

    @F.pandas_udf(TRY)
    def once(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        next_start, stopped = 0.0, False
        for systems, users, made in batches:
            rows = []
            for s, u, n in zip(systems, users, made):
                if u is None or stopped:
                    rows.append((None, NOT_ASKED if u is not None else None, 0, None, False))
                    continue
                if pause:
                    sleep(max(0.0, next_start - time.monotonic()))
                    next_start = time.monotonic() + pause
                start = time.monotonic()
                try:
                    text, problem = fn(s or "", u), None
                except Exception as e:  # the caller's function may raise anything
                    text, problem = None, e
                spent = int((time.monotonic() - start) * 1000)
                rows.append((text, None if problem is None else str(problem), spent, None if problem is None else _wait(problem, int(n) + 1), True))
                stopped = stop and problem is not None and int(n) + 1 >= last
            yield pd.DataFrame(rows, columns=["response", "error", "duration_ms", "wait", "asked"])

    return once.asNondeterministic()(system, user, attempts)


def generate_in_rounds(
    requests: DataFrame, fn: Generator, system: str = "system", user: str = "user", max_attempts: int = MAX_ATTEMPTS,
    partitions: int | None = None, per_minute: int = 0, stop: bool = False, folder: str = "", prior: DataFrame | None = None,
    clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds response, error, attempts and duration_ms to ``requests``.

    Every round is a table, below ``folder`` where one is given. ``prior`` (``request_id`` and ``PRIOR``) holds what
    earlier runs did: requests with a response are not sent again, those without one go on with the attempts
    they have left. ``partitions`` and ``per_minute`` are those of ``generate``.
    """
    spark, columns = requests.sparkSession, requests.columns
    pause = call_pause(requests, per_minute, partitions)
    none = {"_had": F.lit(None).cast("string"), "_made": F.lit(0), "_spent": F.lit(0).cast("long")}
    if prior is not None:
        known = prior.select("request_id", F.col("response").alias("_had"), F.col("attempts").alias("_made"), F.col("duration_ms").alias("_spent"))
        now = requests.join(known, "request_id", "left").withColumns({"_made": F.coalesce("_made", F.lit(0)), "_spent": F.coalesce("_spent", F.lit(0))})
    else:
        now = requests.withColumns(none)
    finished, waiting = [], None
    while True:
        spread = now.repartition(partitions) if partitions else now
        asked = F.when(F.col("_had").isNull(), F.col(user))
        called = spread.withColumn("_try", try_once(fn, F.col(system), asked, F.col("_made"), max_attempts, stop, pause=pause))
        made = F.col("_made") + F.coalesce(F.col("_try.asked"), F.lit(False)).cast("int")
        pending = F.col("_try.asked") & F.col("_try.error").isNotNull() & (made < max_attempts)
        release = F.when(pending, F.lit(clock()) + F.col("_try.wait"))
        done = called.select(
            *[F.col(f"`{c}`") for c in columns], F.coalesce("_had", "_try.response").alias("response"), F.col("_try.error").alias("error"),
            made.alias("attempts"), (F.col("_spent") + F.col("_try.duration_ms")).alias("duration_ms"), release.alias("release_at"),
        )
        path = f"{folder}/tries-{uuid.uuid4().hex}" if folder else new_folder(spark, "tries")
        seen = Observation(uuid.uuid4().hex)
        done.observe(seen, F.min("release_at").alias("next")).write.parquet(path)
        written = spark.read.parquet(path)
        finished.append(written.where("release_at IS NULL").drop("release_at"))
        held = written.where("release_at IS NOT NULL")
        waiting = held if waiting is None else waiting.unionByName(held)
        # requests of earlier rounds may be due before those of this one
        soonest = seen.get["next"] if len(finished) == 1 else waiting.agg(F.min("release_at")).first()[0]
        if soonest is None:
            return reduce(DataFrame.unionByName, finished)
        sleep(max(0.0, soonest - clock()))
        due = F.col("release_at") <= max(soonest, clock()) + SLACK
        again = {"_had": F.lit(None).cast("string"), "_made": F.col("attempts"), "_spent": F.col("duration_ms")}
        now = waiting.where(due).withColumns(again).select(*[F.col(f"`{c}`") for c in columns], "_had", "_made", "_spent")
        waiting = waiting.where(~due)


def earlier_tries(spark: SparkSession, folder: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame | None:
    """``request_id`` and ``PRIOR`` from the rounds of earlier runs; a request that used up its attempts starts anew."""
    try:
        tries = spark.read.parquet(f"{folder}/tries-*")
    except AnalysisException:
        return None
    good = F.col("response").isNotNull()
    found = tries.where(good | (F.col("attempts") < max_attempts) & (F.col("attempts") > 0))
    best = F.max_by(F.struct(*PRIOR), F.struct(good, "attempts")).alias("best")
    gone = tries.where((F.col("attempts") >= max_attempts) & ~good).select("request_id").distinct()
    return found.groupBy("request_id").agg(best).select("request_id", "best.*").join(gone.withColumn("_gone", F.lit(True)), "request_id", "left").where(
        F.col("_gone").isNull() | F.col("response").isNotNull()
    ).drop("_gone")
