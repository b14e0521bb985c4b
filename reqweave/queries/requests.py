"""Records to prompts, request bodies and answers."""

# The prompt and error texts inside the comparison SQL are those that generators are asked with.

from pyspark.sql import functions as F

from reqweave.functions.jsonvals import pretty_record
from reqweave.operators import generate as gen
from reqweave.operators import prompts as ops
from reqweave.operators.answers import check_answers, parse_strict
from reqweave.operators.dialects import DIALECTS, build_request_payload as build_payload
from reqweave.operators.enrich import answer_precedence as precedence, enrich_lookup as lookup
from reqweave.operators.spec import one_job, repair_text, spec_frame
from reqweave.queries.derived import ANSWER, ANSWER_SCHEMA, VALUE
from reqweave.queries.registry import query
from reqweave.storage import materialize

_BAL = "regexp_replace(cast(c_acctbal AS string), '\\.0$', '')"
_PRETTY = f"""concat('{{', chr(10), '  "c_acctbal": ', {_BAL}, ',', chr(10), '  "c_custkey": ', c_custkey, ',', chr(10),
  '  "c_mktsegment": "', c_mktsegment, '",', chr(10), '  "c_name": "', c_name, '",', chr(10), '  "c_nationkey": ', c_nationkey, chr(10), '}}')"""


@query(
    "render_template",
    f"""SELECT c_custkey, concat('Customer ', c_name, ' of nation ', c_nationkey, ' holds ', {_BAL}, ' (<no value>), segment ', to_json(c_mktsegment)) AS prompt FROM customer""",
)
def render_template(t):
    source = "Customer {{ .c_name }} of nation {{.c_nationkey}} holds {{ .c_acctbal }} ({{ .c_phone }}), segment {{ toPrettyJSON .c_mktsegment }}"
    df = t("customer")
    return df.select("c_custkey", ops.render_template(df, source).alias("prompt"))


@query("to_pretty_json", f"SELECT c_custkey, {_PRETTY} AS json FROM customer")
def to_pretty_json(t):
    df = t("customer")
    return df.select("c_custkey", pretty_record(df).alias("json"))


@query(
    "to_pretty_json_nested",
    """SELECT vec_id, concat('{', chr(10), '  "label": ', label, ',', chr(10), '  "parts": {', chr(10), '    "even": ', CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END, ',', chr(10),
  '    "ids": [', chr(10), '      ', vec_id, ',', chr(10), '      ', vec_id + 1, chr(10), '    ],', chr(10), '    "tag": "\\u003c', label, '\\u003e"', chr(10), '  },', chr(10), '  "vec_id": ', vec_id, chr(10), '}') AS json FROM embeddings""",
)
def to_pretty_json_nested(t):
    df = t("embeddings").select(
        "vec_id", "label",
        F.expr("named_struct('tag', concat('<', label, '>'), 'ids', array(vec_id, vec_id + 1), 'even', vec_id % 2 = 0)").alias("parts"),
    )
    return df.select("vec_id", pretty_record(df).alias("json"))


@query(
    "normalize_payload",
    """SELECT event_id, CASE event_id % 7
  WHEN 0 THEN concat('{', chr(10), '  "k": ', json_extract_string(props, '$.k'), chr(10), '}')
  WHEN 1 THEN concat('{', chr(10), '  "input": ', user_id, chr(10), '}')
  WHEN 2 THEN concat('{', chr(10), '  "input": "', event_type, '"', chr(10), '}')
  WHEN 3 THEN concat('[', chr(10), '  ', user_id, ',', chr(10), '  "', event_type, '"', chr(10), ']')
  WHEN 4 THEN concat('{', chr(10), '  "input": true', chr(10), '}')
  WHEN 5 THEN concat('{', chr(10), '  "input": null', chr(10), '}')
  ELSE concat('{', chr(10), '  "input": "plain ', event_type, '"', chr(10), '}') END AS body FROM events""",
)
def normalize_payload(t):
    df = t("events").select("event_id", F.expr(VALUE).alias("value"))
    return ops.record_body(df, " {{ .value }} ", "body").select("event_id", "body")


@query(
    "build_user_prompt",
    f"""SELECT c_custkey, concat('Read the record.', chr(10), chr(10), {_PRETTY}, chr(10), chr(10), 'Answer briefly.', chr(10), chr(10), 'Output ONLY a single JSON object. No markdown. No code fences (```). No text before or after the JSON.', chr(10)) AS prompt FROM customer""",
)
def build_user_prompt(t):
    from reqweave.operators.spec import instructions_text

    nothing = F.lit(None).cast("string")
    body = ops.record_body(t("customer"), "{{ toPrettyJSON .record }}")
    text = ops.user_text(F.col("_body"), "Read the record.", "Answer briefly.", instructions_text(F.lit(False), nothing, nothing))
    return body.select("c_custkey", text.alias("prompt"))


_REPAIR = """concat('Convert the text below into a single valid JSON object. Output ONLY the JSON — no markdown, no code fences, no explanations.', chr(10),
  chr(10), 'Required fields:', chr(10), '  - "fits": boolean (true or false)', chr(10), '  - "kind": string — exactly one of: "A", "B", "C"', chr(10), '  - "points": integer', chr(10),
  chr(10), 'Expected format:', chr(10), '{"fits":true,"kind":"A","points":0}', chr(10), chr(10), 'Text to convert:', chr(10), """


@query("repair_prompt", f"SELECT event_id, {_REPAIR} {ANSWER}) AS prompt FROM events")
def repair_prompt(t):
    job = one_job(spec_frame(t.spark, ANSWER_SCHEMA))
    text = repair_text(F.expr(ANSWER), job.text("field_lines"), job.text("example"))
    return t("events").select("event_id", text.alias("prompt"))


def _echo(system: str, user: str) -> str:
    return f'{{"asked":{len(user)},"rule":"{system}"}}'


@query("generate", """SELECT doc_id, concat('{"asked":', length(text), ',"rule":"count"}') AS response, CAST(NULL AS string) AS error, 1 AS attempts FROM documents""")
def generate(t):
    asked = t("documents").select("doc_id", F.lit("count").alias("system"), F.col("text").alias("user"))
    return gen.generate(asked, _echo).select("doc_id", "response", "error", "attempts")


@query(
    "join_responses",
    """SELECT doc_id, CASE WHEN quality IS NOT NULL THEN concat('{"quality":', quality, '}') END AS response, quality IS NULL AS open FROM documents LEFT JOIN labels USING (doc_id)""",
)
def join_responses(t):
    asked = t("documents").select(F.col("doc_id").alias("request_id"))
    stored = t("labels").select(
        F.col("doc_id").alias("request_id"), F.expr("concat('{\"quality\":', quality, '}')").alias("response"), F.lit(None).cast("string").alias("error")
    )
    left = gen.unanswered(asked, stored).select("request_id", F.lit(True).alias("_open"))
    joined = gen.join_responses(asked, stored).join(left, "request_id", "left")
    return joined.select(F.col("request_id").alias("doc_id"), "response", F.coalesce("_open", F.lit(False)).alias("open"))


def _fix(system: str, user: str) -> str:
    return '{"fits":false,"points":7,"kind":"B"}'


@query(
    "repair_pass",
    """SELECT event_id, CASE WHEN event_id % 14 < 3 THEN user_id ELSE 7 END AS points, event_id % 14 >= 3 AS was_repaired FROM events""",
)
def repair_pass(t):
    from reqweave.config import job_config
    from reqweave.plans.job import checked, repaired

    cfg = job_config({"prompt": {"input_template": "{{ .record }}"}, "processing": {"response_schema": ANSWER_SCHEMA, "thinking": True}})
    job = one_job(spec_frame(t.spark, ANSWER_SCHEMA))
    answers = t("events").select(
        "event_id", "user_id", "event_type", F.expr(ANSWER).alias("response"), F.lit(None).cast("string").alias("call_error")
    )
    fixed = materialize(repaired(checked(answers, cfg, job), cfg, job, _fix), "repaired")
    points = F.try_variant_get(F.element_at("parsed", F.lit("points")), "$", "bigint")
    passed = fixed.where(F.col("error").isNull())
    return passed.select("event_id", points.alias("points"), (F.col("response") != F.expr(ANSWER)).alias("was_repaired"))


@query(
    "audit_log",
    """SELECT concat('doc-', doc_id) AS request_id, 5 AS system_prompt_len, strlen(text) AS user_prompt_len, length(concat('{"asked":', length(text), ',"rule":"count"}')) AS response_len FROM documents""",
)
def audit_log(t):
    asked = t("documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("request_id"), F.lit("count").alias("system"), F.col("text").alias("user")
    )
    log = gen.audit_log(materialize(gen.generate(asked, _echo), "answers"))
    return log.select("request_id", "system_prompt_len", "user_prompt_len", "response_len")


@query("progress_metrics", "SELECT count(*) AS processed, count(*) FILTER (WHERE event_id % 14 < 3) AS ok FROM events")
def progress_metrics(t):
    from pyspark.sql import Observation

    answers = t("events").select("event_id", F.expr(ANSWER).alias("response"))
    done = check_answers(parse_strict(answers, "response", F.lit(True)), one_job(spec_frame(t.spark, ANSWER_SCHEMA)))
    seen = Observation("progress")
    materialize(done.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("error").isNull()).alias("ok")).select("event_id", "error"), "progress")
    return t.spark.createDataFrame([(seen.get["processed"], seen.get["ok"])], "processed long, ok long")


_J = "replace(replace(replace(to_json({}), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"
_S, _U = _J.format("s"), _J.format("u")
_TURN = f"concat('{{\"role\":\"user\",\"content\":', {_U}, '}}')"


@query(
    "build_request_payload",
    f"""WITH q AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE role END AS s, text AS u FROM conversations)
SELECT conv_id, turn, 'chat' AS dialect, concat('{{"model":"m","messages":[', CASE WHEN s <> '' THEN concat('{{"role":"system","content":', {_S}, '}},') ELSE '' END, {_TURN}, '],"max_tokens":50}}') AS body FROM q
UNION ALL SELECT conv_id, turn, 'azure', concat('{{"messages":[', CASE WHEN s <> '' THEN concat('{{"role":"system","content":', {_S}, '}},') ELSE '' END, {_TURN}, '],"max_tokens":50}}') FROM q
UNION ALL SELECT conv_id, turn, 'messages', concat('{{"model":"m","system":', {_S}, ',"messages":[', {_TURN}, '],"max_tokens":50}}') FROM q
UNION ALL SELECT conv_id, turn, 'generate_content', concat('{{', CASE WHEN s <> '' THEN concat('"system_instruction":{{"parts":[{{"text":', {_S}, '}}]}},') ELSE '' END, '"contents":[{{"role":"user","parts":[{{"text":', {_U}, '}}]}}],"generation_config":{{"maxOutputTokens":50}}}}') FROM q
UNION ALL SELECT conv_id, turn, 'generate', concat('{{"model":"m","prompt":', {_U}, CASE WHEN s <> '' THEN concat(',"system":', {_S}) ELSE '' END, ',"stream":false}}') FROM q
UNION ALL SELECT conv_id, turn, 'responses', concat('{{"model":"m",', CASE WHEN s <> '' THEN concat('"instructions":', {_S}, ',') ELSE '' END, '"input":', {_U}, ',"max_output_tokens":50}}') FROM q""",
)
def build_request_payload(t):
    q = t("conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, "").otherwise(F.col("role")).alias("s"), F.col("text").alias("u"))
    bodies = [F.struct(F.lit(d).alias("dialect"), build_payload(d, F.col("s"), F.col("u"), "m", 50).alias("body")) for d in DIALECTS]
    return q.select("conv_id", "turn", F.inline(F.array(*bodies)))


@query(
    "enrich_lookup",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' ELSE concat(left(n_name, 7), CASE WHEN length(n_name) > 7 THEN '…' ELSE '' END) END AS enriched_place
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def enrich_lookup(t):
    k = F.col("c_custkey") % 7
    place = F.when(k == 0, "  ").when(k == 1, "nowhere").otherwise(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")))
    df = t("customer").select("c_custkey", place.alias("place"))
    return lookup(df, "place", t("nation"), "n_nationkey", "n_name", max_chars=7).drop("place")


@query(
    "answer_precedence",
    r"""SELECT concat('q', page_id) AS query, CASE page_id % 5 WHEN 0 THEN concat('short', chr(10), chr(10), 'long ', page_id) WHEN 1 THEN concat('long ', page_id)
  WHEN 2 THEN 'short' WHEN 3 THEN trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) ELSE '' END AS result
FROM (SELECT page_id, url, min(html) OVER (PARTITION BY url) AS html FROM pages)""",
)
def answer_precedence(t):
    k = F.col("page_id") % 5
    topics = F.array(
        F.struct(F.lit("mail").alias("text"), F.lit("mailto:a@example.org").alias("url")),
        F.struct(F.lit("page").alias("text"), F.when(k == 3, F.col("url")).otherwise("").alias("url")),
    )
    asked = t("pages").select(
        F.concat(F.lit("q"), "page_id").alias("query"), F.when(k < 2, F.concat(F.lit("long "), "page_id")).otherwise("").alias("abstract"),
        F.when(k.isin(0, 2), "short").alias("answer"), topics.alias("topics"),
    )
    return precedence(asked, t("pages").select("url", "html"))
