"""Failed calls: which are rate limits, how long to wait, what is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reqweave.functions.text import trim_space

# Status, texts and waits of the retry rule.
TOO_MANY = 429
LIMIT_TEXT = "too_many_requests|rate limit|rate_limit"
MIN_LIMITED_WAIT = 5
MAX_STEP = 6
MAX_ATTEMPTS = 3
HTTP_DATE = "dd MMM yyyy HH:mm:ss z"


def is_rate_limited(status: Column, body: Column) -> Column:
    said = F.lower(F.coalesce(body, F.lit(""))).rlike(LIMIT_TEXT)
    return F.coalesce(status == TOO_MANY, F.lit(False)) | said


def classify_error(status: Column, body: Column) -> Column:
    """ok, rate_limited or error, for a call that returned ``status``."""
    return F.when(status < 300, "ok").when(is_rate_limited(status, body), "rate_limited").otherwise("error")


def backoff_seconds(attempt: Column) -> Column:
    step = F.least(F.greatest(attempt, F.lit(1)), F.lit(MAX_STEP))
    return F.pow(F.lit(2), step - 1).cast("long")


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date after ``now``."""
    h = trim_space(F.coalesce(header, F.lit("")))
    number = F.when(h.rlike(r"^[+-]?\d{1,18}$"), h.cast("long"))
    date = F.try_to_timestamp(F.substring(h, F.lit(6), F.length(h)), F.lit(HTTP_DATE))
    until = F.unix_timestamp(date) - F.unix_timestamp(now)
    return F.greatest(F.coalesce(number, until, F.lit(0)), F.lit(0))


def retry_delay(attempt: Column, limited: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt."""
    plain = backoff_seconds(attempt)
    slow = F.greatest(plain, F.lit(MIN_LIMITED_WAIT), F.coalesce(retry_after, F.lit(0)))
    return F.when(limited, slow).otherwise(plain)


def retry_plan(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of each request from ``attempts(request_id, attempt, ok, response, error)``.

    The first success ends a request; the last error is kept; requests without a
    success and with attempts left are pending. Partial aggregates only.
    """
    outcome = F.struct("response", "error")
    return (
        attempts.groupBy("request_id")
        .agg(
            F.min_by(F.when(F.col("ok"), outcome), F.when(F.col("ok"), F.col("attempt"))).alias("_good"),
            F.max_by(outcome, F.col("attempt")).alias("_last"),
            F.max("attempt").alias("attempts"),
        )
        .select(
            "request_id", "attempts",
            F.when(F.col("_good").isNotNull(), "done")
            .when(F.col("attempts") < max_attempts, "pending").otherwise("failed").alias("state"),
            F.col("_good.response").alias("response"),
            F.when(F.col("_good").isNull(), F.col("_last.error")).alias("error"),
        )
    )


def rate_slots(df: DataFrame, start: Column, per_minute: int, index: str) -> DataFrame:
    """Earliest start of each request; none with ``per_minute`` 0."""
    if per_minute <= 0:
        return df.withColumn("release_at", start.cast("timestamp"))
    micros = F.unix_micros(start.cast("timestamp")) + F.floor(F.col(index) * 60_000_000 / per_minute)
    return df.withColumn("release_at", F.timestamp_micros(micros))
