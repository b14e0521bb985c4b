"""Field hints and the prompt texts made from them, over many jobs."""

# The prompt and error texts inside the comparison SQL are those that generators are asked with.

from pyspark.sql import functions as F

from reqweave.functions import hints as fn
from reqweave.operators import spec as ops
from reqweave.queries.derived import FIELD, HINT, JOB
from reqweave.queries.registry import Tables, query


def spec_of(t: Tables):
    return t("part").select(
        F.expr(JOB).alias("job_id"), F.expr(FIELD).alias("field"), F.expr(HINT).alias("hint"), "p_partkey"
    )


_DESCRIBED = """CASE p_partkey % 12
  WHEN 0 THEN concat('string — exactly one of: "', p_type, '", "', p_brand, '", "', p_name, '"')
  WHEN 1 THEN concat('string — exactly one of: "', p_name, '", "', p_type, '"')
  WHEN 2 THEN concat('string — one of ', p_brand, '/', p_type)
  WHEN 3 THEN 'boolean (true or false)'
  WHEN 4 THEN 'integer' WHEN 5 THEN 'number'
  WHEN 6 THEN concat('string — free remark on ', p_name)
  WHEN 7 THEN 'string' WHEN 8 THEN 'array' WHEN 9 THEN 'object' WHEN 10 THEN 'string'
  ELSE concat('string — ', p_brand, '|') END"""
_KIND = """CASE p_partkey % 12 WHEN 0 THEN 'enum' WHEN 1 THEN 'enum' WHEN 2 THEN 'enum' WHEN 3 THEN 'bool' WHEN 4 THEN 'int'
  WHEN 5 THEN 'number' WHEN 7 THEN 'string' WHEN 8 THEN 'array' WHEN 9 THEN 'object' ELSE 'any' END"""
_ALLOWED = """CASE p_partkey % 12 WHEN 0 THEN concat(p_type, ';', p_brand, ';', p_name) WHEN 1 THEN concat(p_name, ';', p_type)
  WHEN 2 THEN concat(p_brand, ';', p_type) END"""
_EXAMPLE = """CASE p_partkey % 12 WHEN 0 THEN concat('"', p_type, '"') WHEN 1 THEN concat('"', p_name, '"')
  WHEN 2 THEN concat('"', p_brand, '/', p_type, '"') WHEN 3 THEN 'true' WHEN 4 THEN '0' WHEN 5 THEN '0.0'
  WHEN 8 THEN '[]' WHEN 9 THEN '{}' WHEN 11 THEN concat('"', p_brand, '"') ELSE '"<value>"' END"""
_DRY = """CASE p_partkey % 12 WHEN 0 THEN concat('"', p_type, '"') WHEN 1 THEN concat('"', p_name, '"')
  WHEN 2 THEN concat('"', p_brand, '"') WHEN 3 THEN 'false' WHEN 4 THEN '0' WHEN 5 THEN '0'
  WHEN 8 THEN '[]' WHEN 9 THEN '{}' ELSE '"[dry-run]"' END"""


@query("describe_hint", f"SELECT p_partkey, {_DESCRIBED} AS description FROM part")
def describe_hint(t):
    return spec_of(t).select("p_partkey", fn.describe_hint(F.col("hint")).alias("description"))


@query("infer_hint", f"SELECT p_partkey, {_KIND} AS kind FROM part")
def infer_hint(t):
    return spec_of(t).select("p_partkey", fn.infer_kind(F.col("hint")).alias("kind"))


@query("parse_enum", f"SELECT p_partkey, {_ALLOWED} AS allowed FROM part")
def parse_enum(t):
    return spec_of(t).select("p_partkey", F.array_join(fn.parse_enum(F.col("hint")), ";").alias("allowed"))


def _per_job(expression: str, sep: str) -> str:
    return f"string_agg({expression}, '{sep}' ORDER BY {FIELD})"


_PAIR = "concat('\"', " + FIELD + ", '\":', {})"
_EXAMPLE_SQL = "concat('{', " + _per_job(_PAIR.format(_EXAMPLE), ",") + ", '}')"


@query("example_json", f"SELECT {JOB} AS job_id, {_EXAMPLE_SQL} AS example FROM part GROUP BY 1")
def example_json(t):
    return ops.example_json(spec_of(t).drop("p_partkey"))


_LINES = _per_job("concat('  - \"', " + FIELD + ", '\": ', " + _DESCRIBED + ", chr(10))", "")
_THINK = "concat('Step 1 — Reason: think through the task step by step inside a <thinking>...</thinking> block.', chr(10), 'Step 2 — Answer: immediately after the closing </thinking> tag output your final answer.', chr(10), chr(10), 'The final answer (after </thinking>) must be ONLY a single JSON object.')"


@query(
    "format_instructions",
    f"""SELECT job_id, concat(CASE WHEN ends_with(job_id, '0') THEN {_THINK} ELSE 'Output ONLY a single JSON object.' END,
  ' No markdown. No code fences (```). No text before or after the JSON.', chr(10),
  chr(10), 'The JSON object must contain exactly these fields — no more, no fewer:', chr(10), lines,
  chr(10), 'Expected format (replace placeholder values with actual values):', chr(10), example, chr(10)) AS instructions
FROM (SELECT {JOB} AS job_id, {_LINES} AS lines, {_EXAMPLE_SQL} AS example FROM part GROUP BY 1)""",
)
def format_instructions(t):
    spec = spec_of(t).drop("p_partkey")
    jobs = spec.select("job_id").distinct().withColumn("thinking", F.endswith("job_id", F.lit("0")))
    return ops.format_instructions(spec, jobs)


@query(
    "dry_run_generate",
    f"""SELECT p_partkey, response FROM part JOIN (
  SELECT {JOB} AS job_id, concat('{{', {_per_job(_PAIR.format(_DRY), ",")}, '}}') AS response FROM part GROUP BY 1) j ON j.job_id = {JOB}
UNION ALL SELECT -1 - p_partkey, '{{"answer":"[dry-run]"}}' FROM part""",
)
def dry_run_generate(t):
    from reqweave.operators.generate import dry_run_generate as dry_run

    spec = spec_of(t)
    free = spec.select(F.concat(F.lit("free-"), "job_id").alias("job_id"), (-1 - F.col("p_partkey")).alias("p_partkey"))
    requests = spec.select("job_id", "p_partkey").unionByName(free)
    return dry_run(requests, ops.compile_spec(spec), "answer").select("p_partkey", "response")


_SYSTEM = "CASE quality WHEN 1 THEN concat('  Rate document ', cast(doc_id as string), ' ') ELSE ' ' END"


@query(
    "system_prompt",
    f"""WITH n AS (SELECT doc_id, {_SYSTEM} AS s, CASE WHEN doc_id % 3 = 0 THEN 'You must always reason inside a <thinking>...</thinking> block first, then respond with a single valid JSON object. Never include any text, markdown, or code blocks outside those boundaries.'
  WHEN doc_id % 3 = 1 THEN 'You must always respond with a single valid JSON object. Never include text, markdown, or code blocks before or after the JSON.' END AS note FROM labels)
SELECT doc_id, CASE WHEN note IS NULL THEN s WHEN trim(s) = '' THEN note ELSE concat(trim(s), chr(10), chr(10), note) END AS system FROM n""",
)
def system_prompt(t):
    kind = F.col("doc_id") % 3
    text = ops.system_text(F.expr(_SYSTEM), kind == 1, kind == 0)
    return t("labels").select("doc_id", text.alias("system"))


@query(
    "effective_schema",
    """WITH jobs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'why' END AS debug_field, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS debug_hint,
    CASE o_orderkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'text' ELSE '' END AS format FROM orders),
spec AS (SELECT o_orderkey, 'status' AS field, 'F|O|P' AS hint FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, 'why', 'string' FROM orders WHERE o_orderkey % 5 = 0),
debug AS (SELECT o_orderkey, 'why' AS field, CASE WHEN trim(debug_hint) = '' THEN 'short explanation in one sentence' ELSE debug_hint END AS hint FROM jobs WHERE debug_field IS NOT NULL),
explicit AS (SELECT * FROM spec WHERE (o_orderkey, field) NOT IN (SELECT o_orderkey, field FROM debug) UNION ALL SELECT * FROM debug)
SELECT concat('job-', o_orderkey) AS job_id, field, hint FROM explicit
UNION ALL SELECT concat('job-', o_orderkey), 'answer', 'string' FROM jobs WHERE format <> 'json' AND o_orderkey NOT IN (SELECT o_orderkey FROM explicit)""",
)
def effective_schema(t):
    k, job = F.col("o_orderkey"), F.concat(F.lit("job-"), F.col("o_orderkey"))
    orders = t("orders").withColumn("job_id", job)
    jobs = orders.select(
        "job_id", F.when(k % 3 == 0, "why").alias("debug_field"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("debug_hint"),
        F.lit(" answer").alias("response_field"), F.when(k % 4 == 0, "json").when(k % 4 == 1, "text").otherwise("").alias("response_format"),
        F.lit(False).alias("parse_json"),
    )
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(h).alias("hint")) for n, h in [("status", "F|O|P"), ("why", "string")]])
    spec = orders.where(k % 5 == 0).select("job_id", F.inline(fields))
    return ops.effective_schema(spec, jobs)
