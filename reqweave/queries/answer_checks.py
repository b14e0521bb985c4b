"""Parsing and checking of answers."""

# The prompt and error texts inside the comparison SQL are those that generators are asked with.

from pyspark.sql import functions as F

from reqweave.functions.jsonvals import array_items, framed, framed_value, value_kind
from reqweave.functions.salvage import escape_control_chars as escape_controls
from reqweave.functions.salvage import extract_first_json as first_json
from reqweave.functions.salvage import extract_last_json as last_json
from reqweave.operators import answers as ops
from reqweave.operators.merge import key_conflict as conflicts, store_response as store
from reqweave.operators.spec import compile_spec, one_job, spec_frame
from reqweave.queries.derived import ANSWER, ANSWER_ERROR, ANSWER_SCHEMA, KEYS, VALUE
from reqweave.queries.registry import Tables, query
from reqweave.storage import materialize

_GOOD = "event_id % 14 < 3"
_BARE = "concat('{\"fits\":true,\"kind\":\"A\",\"points\":', cast(user_id as string), '}')"


def answers_of(t: Tables):
    return t("events").select("event_id", "user_id", F.expr(ANSWER).alias("response"))


def written_answers(t: Tables):
    """Checked answers as a job keeps them: written, then read as often as needed."""
    return materialize(checked_answers(t), "checked")


def checked_answers(t: Tables):
    job = one_job(spec_frame(t.spark, ANSWER_SCHEMA))
    return ops.check_answers(ops.parse_strict(answers_of(t), "response", F.lit(True)), job)


@query(
    "parse_strict_object",
    f"""SELECT event_id, event_id % 14 IN (0, 1, 2, 4, 5, 6, 7, 11, 13) AS parsed_ok,
  CASE WHEN event_id % 14 NOT IN (4, 5, 6, 7, 11, 13) THEN {ANSWER_ERROR} END AS error FROM events""",
)
def parse_strict_object(t):
    parsed = ops.parse_strict(answers_of(t), "response", F.lit(True))
    return parsed.select("event_id", F.col("parsed").isNotNull().alias("parsed_ok"), "error")


@query("unwrap_code_fence", f"SELECT event_id, CASE WHEN event_id % 14 = 2 THEN concat('{{\"fits\":true,\"points\":', user_id, ',\"kind\":\"A\"}}') END AS inner_text FROM events")
def unwrap_code_fence(t):
    return answers_of(t).select("event_id", ops.unwrap_code_fence(F.col("response")).alias("inner_text"))


@query(
    "split_thinking",
    f"""SELECT event_id, CASE event_id % 14 WHEN 10 THEN 'response is empty' WHEN 12 THEN 'thinking mode requires a closing </thinking> tag' END AS error,
  CASE WHEN event_id % 14 IN (10, 12) THEN NULL WHEN event_id % 14 = 1 THEN regexp_replace(a, '^<thinking>.*</thinking>', '') ELSE a END AS body
FROM (SELECT event_id, {ANSWER} AS a FROM events)""",
)
def split_thinking(t):
    return answers_of(t).select("event_id", ops.split_thinking(F.col("response"), F.lit(True)).alias("s")).select("event_id", "s.error", "s.body")


@query(
    "check_keys",
    f"""SELECT event_id, CASE event_id % 14 WHEN 4 THEN '{KEYS} (missing: kind)' WHEN 5 THEN '{KEYS} (extra: note)'
  WHEN 11 THEN '{KEYS} (missing: fits, kind, points)' END AS error
FROM events""",
)
def check_keys(t):
    parsed = ops.parse_strict(answers_of(t), "response", F.lit(True))
    names = F.array(*map(F.lit, sorted(ANSWER_SCHEMA)))
    return parsed.select("event_id", ops.key_error(F.col("parsed"), names).alias("error"))


@query("check_types", f"SELECT event_id, {ANSWER_ERROR} AS error FROM events")
def check_types(t):
    return checked_answers(t).select("event_id", "error")


# one job per hundred events, each with its own allowed values
_MANY = "concat('{\"kind\":\"', event_type, '\",\"n\":', cast(user_id as string), '}')"


@query(
    "check_many_jobs",
    f"""WITH jobs AS (SELECT event_id // 100 AS job, min(event_type) AS low, max(event_type) AS high FROM events GROUP BY 1)
SELECT event_id, CASE WHEN low = high THEN NULL WHEN event_type IN (low, high) THEN NULL
  ELSE concat('field "kind" must be one of ', low, '|', high) END AS error
FROM events JOIN jobs ON job = event_id // 100""",
)
def check_many_jobs(t):
    job = F.floor(F.col("event_id") / 100).cast("string").alias("job_id")
    events = t("events").select("event_id", job, F.expr(_MANY).alias("response"), "event_type")
    per_job = events.groupBy("job_id").agg(F.concat_ws("|", F.min("event_type"), F.max("event_type")).alias("hint"))
    spec = per_job.select("job_id", F.inline(F.array(
        F.struct(F.lit("kind").alias("field"), F.col("hint")), F.struct(F.lit("n").alias("field"), F.lit("int").alias("hint")),
    )))
    return ops.check_answers(ops.parse_strict(events, "response"), compile_spec(spec)).select("event_id", "error")


@query(
    "parse_strict_array",
    f"""SELECT event_id, CASE event_id % 7 WHEN 3 THEN 2 WHEN 5 THEN 0 END AS n_items,
  CASE WHEN event_id % 7 IN (3, 5) THEN NULL ELSE 'invalid JSON array' END AS error FROM events""",
)
def parse_strict_array(t):
    parsed = ops.parse_array(t("events").select("event_id", F.expr(VALUE).alias("response")))
    return parsed.select("event_id", F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"), "error")


@query(
    "spread_fields",
    f"""SELECT event_id, true AS fits, 'A' AS kind, user_id AS points FROM events WHERE {_GOOD}""",
)
def spread_fields(t):
    good = written_answers(t).where(F.col("error").isNull())
    return ops.spread_fields(good, {"fits": "bool", "points": "int", "kind": "enum"}).select(
        "event_id", "fits", "kind", "points"
    )


@query(
    "route_errors",
    f"""SELECT event_id, 'errors' AS target, {ANSWER_ERROR} AS error, length({ANSWER}) AS answer_length FROM events WHERE NOT {_GOOD}
UNION ALL SELECT event_id, 'main', NULL, length({ANSWER}) FROM events WHERE {_GOOD}""",
)
def route_errors(t):
    from reqweave.operators.generate import route_errors as route

    asked = checked_answers(t).withColumns({"system": F.lit("Check events."), "user": F.concat(F.lit("event "), "event_id")})
    good, bad = route(materialize(asked.drop("parsed"), "checked"), "event_id")
    pick = lambda df, target: df.select("event_id", F.lit(target).alias("target"), "error", F.length("response").alias("answer_length"))
    return pick(good, "main").unionByName(pick(bad, "errors"))


@query(
    "store_response",
    f"""SELECT event_id, {ANSWER} AS raw, CASE WHEN event_id % 14 IN (0, 1, 2) THEN {_BARE} END AS shown FROM events WHERE {_GOOD}""",
)
def store_response(t):
    good = written_answers(t).where(F.col("error").isNull())
    kept = store(store(good, "raw", thinking=True), "shown", thinking=True, show_thinking=False)
    return store(kept, "switched_off", keep_raw=False).select("event_id", "raw", "shown")


@query(
    "merge_response",
    """SELECT doc_id, quality + 1 AS quality, toxic, concat('doc ', doc_id) AS remark, true AS conflict FROM labels""",
)
def merge_response(t):
    answer = F.expr("concat('{\"quality\":', quality + 1, ',\"remark\":\"doc ', doc_id, '\"}')")
    parsed = ops.parse_strict(t("labels").withColumn("response", answer))
    marked = parsed.withColumn("conflict", conflicts(F.col("parsed"), ["doc_id", "quality", "toxic"]))
    return ops.spread_fields(marked, {"quality": "int", "remark": "string"}).select("doc_id", "quality", "toxic", "remark", "conflict")


@query("key_conflict", "SELECT event_id, CASE WHEN event_id % 14 IN (0, 1, 2, 4, 5, 6, 7, 11, 13) THEN event_id % 14 = 5 END AS conflict FROM events")
def key_conflict(t):
    # the input of these answers has a column named note, which one of them overwrites
    parsed = ops.parse_strict(answers_of(t), "response", F.lit(True))
    return parsed.select("event_id", conflicts(F.col("parsed"), ["event_id", "note"]).alias("conflict"))


_MIXED = f"concat('Result for {{', event_type, '}}: ', {ANSWER}, ' done.')"


@query(
    "extract_last_json",
    f"""SELECT event_id, CASE WHEN event_id % 14 IN (4, 5, 6, 7, 13) THEN a WHEN event_id % 14 IN (0, 1, 2, 3, 8, 12) THEN concat('{{"fits":true,"points":', user_id, ',"kind":"A"}}') END AS json
FROM (SELECT event_id, user_id, {ANSWER} AS a FROM events)""",
)
def extract_last_json(t):
    return t("events").select("event_id", last_json(F.expr(_MIXED)).alias("json"))


@query(
    "parse_lenient",
    f"""SELECT event_id, CASE WHEN event_id % 14 IN (9, 10, 11) THEN NULL WHEN event_id % 14 IN (0, 1, 2, 3, 8, 12) THEN cast(user_id AS string)
  WHEN event_id % 14 = 5 THEN '1' ELSE cast(user_id AS string) END AS points FROM events""",
)
def parse_lenient(t):
    parsed = ops.parse_lenient(t("events").select("event_id", F.expr(_MIXED).alias("response")))
    points = F.element_at("parsed", F.lit("points"))
    return parsed.select("event_id", F.try_variant_get(points, "$", "string").alias("points"))


_RAW = "concat('Config follows: {\"task\":\"line one', chr(10), 'line {two}', chr(9), '\",\"id\":', cast(event_id as string), ',\"inner\":{\"k\":', cast(user_id as string), '}} and {\"later\":1}')"


@query("extract_first_json", f"SELECT event_id, substr(r, 17, length(r) - 16 - 16) AS json FROM (SELECT event_id, {_RAW} AS r FROM events)")
def extract_first_json(t):
    return t("events").select("event_id", first_json(F.expr(_RAW)).alias("json"))


@query("escape_control_chars", f"SELECT event_id, replace(replace({_RAW}, chr(10), '\\n'), chr(9), '\\t') AS fixed FROM events")
def escape_control_chars(t):
    return t("events").select("event_id", escape_controls(F.expr(_RAW)).alias("fixed"))


@query("salvage_object", "SELECT event_id, concat('line one', chr(10), 'line {two}', chr(9)) AS task, user_id AS k FROM events")
def salvage_object(t):
    found = ops.salvage_object(t("events").select("event_id", F.expr(_RAW).alias("r")), "r")
    return found.select(
        "event_id", F.try_variant_get(F.element_at("salvaged", F.lit("task")), "$", "string").alias("task"),
        F.try_variant_get(F.element_at("salvaged", F.lit("inner")), "$.k", "bigint").alias("k"),
    )


@query(
    "value_type",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'object' WHEN 1 THEN 'number' WHEN 2 THEN 'string' WHEN 3 THEN 'array' WHEN 4 THEN 'bool' WHEN 5 THEN 'null' END AS kind FROM events""",
)
def value_type(t):
    values = t("events").select("event_id", framed(F.expr(VALUE)).alias("f"))
    return values.select("event_id", value_kind(framed_value(F.col("f"))).alias("kind"))
