"""Calling the user's generator over partitions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reqweave.operators.hotkeys import spread_join
from reqweave.operators.retry import MAX_ATTEMPTS, MAX_STEP, MIN_LIMITED_WAIT
from reqweave.operators.spec import DEFAULT_FIELD, OneJob
from reqweave.functions.hints import DRY_TEXT
from reqweave.functions.jsonvals import quoted

Generator = Callable[[str, str], str]
ANSWER = "response string, error string, attempts int, duration_ms long"


class RateLimited(Exception):
    """Raised by a generator whose provider asks for a slower pace."""

    def __init__(self, message: str, retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


def _wait(problem: Exception, attempt: int) -> float:
    seconds = 2.0 ** (min(attempt, MAX_STEP) - 1)
    if isinstance(problem, RateLimited):
        seconds = max(seconds, MIN_LIMITED_WAIT, problem.retry_after)
    return seconds


def _call(fn: Generator, system: str, user: str, max_attempts: int, sleep) -> tuple:
    start, problem = time.monotonic(), None
    for attempt in range(1, max_attempts + 1):
        try:
            text = fn(system, user)
            return text, None, attempt, int((time.monotonic() - start) * 1000)
        except Exception as e:  # the caller's function may raise anything
            problem = e
            if attempt < max_attempts:
                sleep(_wait(e, attempt))
    return None, str(problem), max_attempts, int((time.monotonic() - start) * 1000)


def call_generator(
    fn: Generator, system: Column, user: Column, max_attempts: int = MAX_ATTEMPTS, sleep=time.sleep, pause: float = 0.0
) -> Column:
    """Answer struct (response, error, attempts, duration_ms) per row.

    ``pause`` is the least time in seconds between two calls of one task.

    Only the two prompt columns travel to Python; the rest of the row waits in the
    JVM. Rows with a null user text are not sent. Write the result before reading
    it twice (``materialize``): calls cost money and do not repeat.
    """

    @F.pandas_udf(ANSWER)
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        next_start = 0.0
        for systems, users in batches:
            rows = []
            for s, u in zip(systems, users):
                if u is None:
                    rows.append((None, None, 0, 0))
                    continue
                if pause:
                    sleep(max(0.0, next_start - time.monotonic()))
                    next_start = time.monotonic() + pause
                rows.append(_call(fn, s or "", u, max_attempts, sleep))
            yield pd.DataFrame(rows, columns=["response", "error", "attempts", "duration_ms"])

    return answer.asNondeterministic()(system, user)


def call_pause(df: DataFrame, per_minute: int, tasks: int | None = None) -> float:
    """Seconds between two calls of one task, so that all running tasks keep within ``per_minute``.

    Without a number of tasks that many run at once as the session has slots; rows then
    stay where they are. A session that grows later needs the number.
    """
    return 60.0 * (tasks or df.sparkSession.sparkContext.defaultParallelism) / per_minute if per_minute > 0 else 0.0


def generate(
    requests: DataFrame, fn: Generator, system: str = "system", user: str = "user",
    max_attempts: int = MAX_ATTEMPTS, partitions: int | None = None, sleep=time.sleep, per_minute: int = 0,
) -> DataFrame:
    """Adds response, error, attempts and duration_ms.

    ``partitions`` sets how many calls run at once. ``per_minute`` limits the calls
    of the whole stage; every running task gets its share (see ``call_pause``).
    """
    pause = call_pause(requests, per_minute, partitions)
    spread = requests.repartition(partitions) if partitions else requests
    called = spread.withColumn("_answer", call_generator(fn, F.col(system), F.col(user), max_attempts, sleep, pause))
    return called.select("*", "_answer.*").drop("_answer")


def join_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers produced elsewhere; requests without one keep a null response."""
    return requests.join(responses.select("request_id", "response", "error"), "request_id", "left")


def unanswered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """What a restart still has to send."""
    return requests.join(responses.select("request_id"), "request_id", "left_anti")


def dry_run_generate(requests: DataFrame, spec: DataFrame | OneJob, response_field: str = DEFAULT_FIELD) -> DataFrame:
    """Placeholder answers that pass each job's checks; with a compiled table of
    many jobs ``requests`` has job_id."""
    key = response_field.strip() or DEFAULT_FIELD
    plain = F.concat(F.lit("{"), quoted(F.lit(key)), F.lit(f':"{DRY_TEXT}"}}'))
    if isinstance(spec, OneJob):
        return requests.withColumn("response", F.coalesce(spec.text("dry_answer"), plain))
    answers = spec.select(F.col("job_id").alias("_spec_job"), F.col("dry_answer").alias("_dry"))
    return spread_join(requests, answers, "job_id", "_spec_job").withColumn("response", F.coalesce("_dry", plain)).drop("_dry", "_spec_job")


def audit_log(answered: DataFrame) -> DataFrame:
    """Prompt and answer texts with their lengths and the time of each call."""
    return answered.select(
        "request_id", F.col("system").alias("system_prompt"), F.col("user").alias("user_prompt"),
        F.octet_length("system").alias("system_prompt_len"), F.octet_length("user").alias("user_prompt_len"),
        "response", F.octet_length("response").alias("response_len"), "error", "duration_ms",
    )


# Fixed value: layout of an error report.
REPORT = "{}: {}\n----- LLM SYSTEM PROMPT -----\n{}\n----- LLM USER PROMPT -----\n{}\n----- LLM RESPONSE -----\n{}"


def error_report(prefix: Column, error: Column, system: Column, user: Column, response: Column) -> Column:
    """Error with the prompts and the answer it belongs to."""
    between = REPORT.split("{}")[1:-1]
    parts = [prefix]
    for text, value in zip(between, [error, system, user, response]):
        parts += [F.lit(text), F.coalesce(value, F.lit(""))]
    return F.concat(*parts)


def route_errors(checked: DataFrame, index: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, error table). Read both from a written frame."""
    prefix = F.concat(F.lit("record "), F.col(index).cast("string"))
    report = error_report(prefix, F.col("error"), F.col("system"), F.col("user"), F.col("response"))
    errors = checked.where(F.col("error").isNotNull())
    return (
        checked.where(F.col("error").isNull()),
        errors.select(index, "error", "system", "user", "response", report.alias("report")),
    )
