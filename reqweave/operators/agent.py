"""Rounds of generate, run the tools asked for, show the results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reqweave.operators.generate import _wait
from reqweave.operators.retry import MAX_ATTEMPTS
from reqweave.operators.tools import PAGE_TOOLS, TOOLS, dispatch_tools
from reqweave.storage import materialize

CALL = "struct<id:string,name:string,args:string>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string,tool_name:string>"
STEP = f"content string, calls array<{CALL}>, error string"
# Fixed value: how many rounds a record may take.
MAX_ROUNDS = 5
#: Calls of a record that are answered inside its row.
CALLS_IN_ROW = 4

Step = Callable[[list[dict], list[str]], dict]


def _message(role: str, content, calls=None, call_id=None, tool=None):
    none = F.lit(None)
    return F.struct(
        F.lit(role).alias("role"), content.alias("content"),
        (calls if calls is not None else none.cast(f"array<{CALL}>")).alias("tool_calls"),
        (call_id if call_id is not None else none.cast("string")).alias("tool_call_id"),
        (tool if tool is not None else none.cast("string")).alias("tool_name"),
    )


def _one_step(fn: Step, messages: str, tools: list[str], max_attempts: int, sleep) -> tuple:
    problem = None
    for attempt in range(1, max_attempts + 1):
        try:
            answer = fn(json.loads(messages), tools)
            calls = [{k: c.get(k) for k in ("id", "name", "args")} for c in answer.get("tool_calls") or []]
            return answer.get("content") or "", calls, None
        except Exception as e:  # the caller's function may raise anything
            problem = e
            if attempt < max_attempts:
                sleep(_wait(e, attempt))
    return None, [], str(problem)


def agent_rounds(
    requests: DataFrame, step: Step, pages: DataFrame | None = None, tools: list[str] = TOOLS,
    max_rounds: int = MAX_ROUNDS, max_attempts: int = MAX_ATTEMPTS, sleep=time.sleep, pause: float = 0.0, **stored,
) -> DataFrame:
    """``requests(request_id, system, user, ..)`` plus response, error and rounds.

    Records are written once under a key of their own; only keys and messages go through the rounds, and the answers
    meet their records at the end. Each round is written before it is read, so the generator is called once per
    open record and round, and the plan does not grow with the rounds. ``pause`` is the
    time between two calls of one task; ``stored`` goes to ``dispatch_tools``.
    """
    columns = requests.columns
    max_rounds = max_rounds if max_rounds > 0 else MAX_ROUNDS

    @F.pandas_udf(STEP)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        next_start = 0.0
        for batch in batches:
            rows = []
            for m in batch:
                if pause:
                    sleep(max(0.0, next_start - time.monotonic()))
                    next_start = time.monotonic() + pause
                rows.append(_one_step(step, m, tools, max_attempts, sleep))
            yield pd.DataFrame(rows, columns=["content", "calls", "error"])

    ask = ask.asNondeterministic()
    start = F.array(_message("system", F.col("system")), _message("user", F.col("user"))).cast(f"array<{MESSAGE}>")
    keyed = materialize(requests.withColumn("_key", F.monotonically_increasing_id()), "records")
    open_rows, finished = keyed.select("_key", start.alias("_messages")), []
    answer = lambda rows, response, error, n: rows.select("_key", response.alias("response"), error.alias("error"), F.lit(n).alias("rounds"))
    for round_no in range(1, max_rounds + 1):
        asks = F.col("_step.error").isNull() & (F.size("_step.calls") > 0)
        stepped = open_rows.withColumn("_step", ask(F.to_json("_messages")))
        # messages are needed again only where tools are asked for
        going = asks if round_no < max_rounds else F.lit(False)
        stepped = materialize(stepped.select("_key", F.when(going, F.col("_messages")).alias("_messages"), "_step"), f"round-{round_no}")
        finished.append(answer(stepped.where(~asks), F.when(F.col("_step.error").isNull(), F.col("_step.content")), F.col("_step.error"), round_no))
        asked = stepped.where(asks)
        if asked.isEmpty():
            break
        if round_no == max_rounds:
            late = F.lit(f"exceeded maximum tool-calling rounds ({max_rounds})")
            finished.append(answer(asked, F.lit(None).cast("string"), late, round_no))
            break
        open_rows = _answer_calls(asked, pages, tools, stored)
    answers = reduce(DataFrame.unionByName, finished)
    return keyed.join(answers, "_key").select(*[F.col(f"`{c}`") for c in columns], "response", "error", "rounds")


def _answer_calls(asked: DataFrame, pages: DataFrame | None, tools: list[str], stored: dict) -> DataFrame:
    """Run the calls of a round and put their results behind the messages.

    Tools that need nothing but the call answer the first ``CALLS_IN_ROW`` calls of a record inside its row, so that no
    message travels. Records with more calls, and calls that are joined with stored pages or answers, go by ``_gathered``.
    """
    joined = (pages is not None and set(PAGE_TOOLS) & set(tools)) or stored.get("searches") is not None or stored.get("most_statements", 0) > 0
    most = 0 if joined else min(asked.agg(F.max(F.size("_step.calls"))).first()[0], CALLS_IN_ROW)
    many = asked.where(F.size("_step.calls") > most)
    rows = asked.where(F.size("_step.calls") <= most).select(
        "_key", _with_request().alias("_messages"), F.col("_step.calls").alias("_calls"),
    )
    for k in range(most):
        call = F.get("_calls", F.lit(k))
        one = rows.withColumns({"_id": call["id"], "name": call["name"], "args": call["args"]})
        done = dispatch_tools(one, enabled=tools)
        reply = F.array(_message("tool", F.col("result"), call_id=F.col("_id"), tool=F.col("name"))).cast(f"array<{MESSAGE}>")
        grown = F.when(F.size("_calls") > k, F.concat("_messages", reply)).otherwise(F.col("_messages"))
        rows = done.select("_key", grown.alias("_messages"), "_calls")
    rows = rows.select("_key", "_messages")
    return rows if most and many.isEmpty() else rows.unionByName(_gathered(many, pages, tools, stored))


def _with_request():
    said = F.array(_message("assistant", F.col("_step.content"), F.col("_step.calls"))).cast(f"array<{MESSAGE}>")
    return F.concat("_messages", said)


def _gathered(asked: DataFrame, pages: DataFrame | None, tools: list[str], stored: dict) -> DataFrame:
    """One row per call; one shuffle brings the results of a record together."""
    calls = asked.select("_key", _with_request().alias("_all"), F.posexplode("_step.calls").alias("_no", "_call"))
    # the messages so far travel with the first call only
    calls = calls.select(
        "_key", F.when(F.col("_no") == 0, F.col("_all")).alias("_history"), "_no",
        F.col("_call.id").alias("_id"), F.col("_call.name").alias("name"), F.col("_call.args").alias("args"),
    )
    done = dispatch_tools(calls, pages, tools, **stored)
    reply = F.struct("_no", _message("tool", F.col("result"), call_id=F.col("_id"), tool=F.col("name")).alias("m"))
    back = done.groupBy("_key").agg(F.any_value("_history", ignoreNulls=True).alias("_history"), F.array_sort(F.collect_list(reply)).alias("_replies"))
    messages = F.concat("_history", F.transform("_replies", lambda r: r["m"]))
    return back.select("_key", messages.cast(f"array<{MESSAGE}>").alias("_messages"))
