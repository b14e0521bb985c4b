"""Failed calls, waiting times and provider envelopes."""

from pyspark.sql import functions as F

from reqweave.operators import retry as ops
from reqweave.operators.dialects import extract_response_text as response_text, extract_tool_calls as tool_calls
from reqweave.queries.registry import query

_STATUS = "CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 503 ELSE 400 END"
_BODY = "CASE event_id % 5 WHEN 2 THEN concat('Rate Limit for ', event_type) WHEN 3 THEN concat('busy: ', event_type) WHEN 4 THEN concat('{\"code\":\"too_many_requests\",\"k\":', cast(user_id as string), '}') ELSE '' END"


@query("classify_error", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 3 THEN 'error' ELSE 'rate_limited' END AS outcome FROM events")
def classify_error(t):
    return t("events").select("event_id", ops.classify_error(F.expr(_STATUS), F.expr(_BODY)).alias("outcome"))


@query(
    "retry_delay",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(CAST(pow(2, least(greatest(event_id % 9, 1), 6) - 1) AS BIGINT), 5, CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN 90 ELSE 0 END)
  ELSE CAST(pow(2, least(greatest(event_id % 9, 1), 6) - 1) AS BIGINT) END AS seconds FROM events""",
)
def retry_delay(t):
    k = F.col("event_id")
    ninety = F.date_format(F.date_trunc("second", F.col("ts")) + F.expr("interval 90 seconds"), "dd MMM yyyy HH:mm:ss")
    header = (
        F.when(k % 4 == 0, F.col("user_id").cast("string"))
        .when(k % 4 == 1, F.concat(F.lit("Mon, "), ninety, F.lit(" GMT")))
        .when(k % 4 == 2, "-5").otherwise("soon")
    )
    after = ops.retry_after_seconds(header, F.date_trunc("second", F.col("ts")))
    return t("events").select("event_id", ops.retry_delay((k % 9).cast("int"), k % 3 == 0, after).alias("seconds"))


@query(
    "retry_plan",
    """WITH a AS (SELECT event_id // 3 AS request_id, event_id % 3 + 1 AS attempt, event_type = 'click' AS ok, event_type FROM events),
g AS (SELECT request_id, max(attempt) AS attempts, min(attempt) FILTER (WHERE ok) AS won FROM a GROUP BY 1)
SELECT request_id, attempts, CASE WHEN won IS NOT NULL THEN 'done' WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS state,
  CASE WHEN won IS NOT NULL THEN concat('answer ', won) END AS response, CASE WHEN won IS NULL THEN l.event_type END AS error
FROM g JOIN a l USING (request_id) WHERE l.attempt = g.attempts""",
)
def retry_plan(t):
    ok = F.col("event_type") == "click"
    attempt = (F.col("event_id") % 3 + 1).alias("attempt")
    attempts = t("events").select(
        F.floor(F.col("event_id") / 3).alias("request_id"), attempt, ok.alias("ok"),
        F.when(ok, F.concat(F.lit("answer "), F.col("event_id") % 3 + 1)).alias("response"), F.when(~ok, F.col("event_type")).alias("error"),
    )
    return ops.retry_plan(attempts)


@query("rate_slots", "SELECT event_id, epoch_us(ts) + event_id * 60000000 // 45 AS release_us FROM events")
def rate_slots(t):
    slots = ops.rate_slots(t("events").select("event_id", "ts"), F.col("ts"), 45, "event_id")
    return slots.select("event_id", F.unix_micros("release_at").alias("release_us"))


_TEXT = "concat('text ', cast(user_id as string))"
_ENVELOPES = {
    "chat": f"""CASE event_id % 4 WHEN 0 THEN concat('{{"choices":[{{"message":{{"content":"', {_TEXT}, '"}},"finish_reason":"stop"}}]}}')
      WHEN 1 THEN '{{"choices":[]}}' WHEN 2 THEN '{{"choices":[{{"message":{{"content":null}}}}]}}' ELSE concat('{{"error":{{"message":"bad ', event_type, '","type":"invalid"}}}}') END""",
    "messages": f"""CASE event_id % 4 WHEN 0 THEN concat('{{"content":[{{"type":"tool_use","id":"1"}},{{"type":"text","text":"', {_TEXT}, '"}},{{"type":"text","text":"two"}}]}}')
      WHEN 1 THEN '{{"content":[]}}' WHEN 2 THEN '{{"content":[{{"type":"tool_use","id":"1"}}]}}' ELSE concat('{{"error":{{"type":"overloaded","message":"bad ', event_type, '"}}}}') END""",
    "generate_content": f"""CASE event_id % 4 WHEN 0 THEN concat('{{"candidates":[{{"content":{{"parts":[{{"text":"', {_TEXT}, '"}}]}}}}]}}')
      WHEN 1 THEN '{{"candidates":[]}}' WHEN 2 THEN '{{"candidates":[{{"content":{{"parts":[]}}}}]}}' ELSE concat('{{"error":{{"code":400,"message":"bad ', event_type, '"}}}}') END""",
    "generate": f"""CASE event_id % 4 WHEN 3 THEN concat('{{"error":"bad ', event_type, '"}}') WHEN 0 THEN concat('{{"response":"', {_TEXT}, '"}}') ELSE '{{}}' END""",
    "responses": f"""CASE event_id % 4 WHEN 3 THEN 'not json' WHEN 0 THEN concat('{{"output_text":"', {_TEXT}, '"}}') ELSE '{{}}' END""",
}


@query(
    "extract_response_text",
    """WITH d(dialect, e1, e2, e3) AS (VALUES
  ('chat', 'no choices returned by api', 'no content in response', 'api error (invalid): bad '),
  ('messages', 'no text content returned by anthropic', 'no text content returned by anthropic', 'anthropic api error (overloaded): bad '),
  ('generate_content', 'no content returned by gemini', 'no content returned by gemini', 'gemini api error: bad '),
  ('generate', NULL, NULL, 'ollama api error: bad '), ('responses', NULL, NULL, 'decode response'))
SELECT dialect, event_id, CASE WHEN event_id % 4 = 0 THEN concat('text ', user_id) WHEN event_id % 4 < 3 AND e1 IS NULL THEN '' END AS text,
  CASE event_id % 4 WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN CASE WHEN dialect = 'responses' THEN e3 ELSE concat(e3, event_type) END END AS error
FROM events, d""",
)
def extract_response_text(t):
    parts = [F.struct(F.lit(d).alias("dialect"), response_text(d, F.expr(e)).alias("r")) for d, e in _ENVELOPES.items()]
    # a table of few row groups is read by few tasks, but reading envelopes is work for all of them
    events = t("events").select("event_id", "user_id", "event_type").repartition(4 * t.spark.sparkContext.defaultParallelism)
    return events.select("event_id", F.inline(F.array(*parts))).select("dialect", "event_id", "r.text", "r.error")


_CHAT_CALLS = f"""CASE event_id % 3 WHEN 0 THEN concat('{{"choices":[{{"message":{{"content":"', {_TEXT}, '"}}}}]}}')
  ELSE concat('{{"choices":[{{"message":{{"content":null,"tool_calls":[{{"id":"c', cast(event_id as string), '","type":"function","function":{{"name":"text_stats","arguments":"{{}}"}}}},{{"id":"d","function":{{"name":"', event_type, '","arguments":"x"}}}}]}}}}]}}') END"""
_BLOCK_CALLS = f"""CASE event_id % 3 WHEN 0 THEN concat('{{"content":[{{"type":"text","text":"', {_TEXT}, '"}}]}}')
  ELSE concat('{{"content":[{{"type":"text","text":"a"}},{{"type":"tool_use","id":"c', cast(event_id as string), '","name":"text_stats","input":{{"text":"', event_type, '"}}}},{{"type":"text","text":"b"}}]}}') END"""


@query(
    "extract_tool_calls",
    """SELECT event_id, 'chat' AS dialect, CASE WHEN event_id % 3 = 0 THEN concat('text ', user_id) ELSE '' END AS content,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('c', event_id, ' text_stats {};d ', event_type, ' x') END AS calls FROM events
UNION ALL SELECT event_id, 'messages', CASE WHEN event_id % 3 = 0 THEN concat('text ', user_id) ELSE 'ab' END,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('c', event_id, ' text_stats {"text":"', event_type, '"}') END FROM events""",
)
def extract_tool_calls(t):
    found = F.array(
        F.struct(F.lit("chat").alias("dialect"), tool_calls("chat", F.expr(_CHAT_CALLS)).alias("r")),
        F.struct(F.lit("messages").alias("dialect"), tool_calls("messages", F.expr(_BLOCK_CALLS)).alias("r")),
    )
    shown = F.array_join(F.transform("r.calls", lambda c: F.concat_ws(" ", c["id"], c["name"], c["args"])), ";")
    return t("events").select("event_id", F.inline(found)).select("event_id", "dialect", F.col("r.content").alias("content"), shown.alias("calls"))
