"""Tool calls over tables, rounds of them, and name lists."""

import json

from pyspark.sql import functions as F

from reqweave.operators import tools as ops
from reqweave.operators.agent import agent_rounds as rounds
from reqweave.queries.registry import SQL, query


def _args(**members):
    return F.to_json(F.struct(*[c.alias(k) for k, c in members.items()]))


@query(
    "dispatch_tools",
    r"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, text, lang, regexp_extract_all(text, '[A-Z][a-z]+')[1:3] AS m FROM documents)
SELECT doc_id, CASE k
  WHEN 0 THEN md5(concat('{"bytes":', strlen(text), ',"characters":', length(text), ',"lines":', length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END,
    ',"paragraphs":', len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\S'))),
    ',"trimmed":', replace(replace(replace(to_json(regexp_replace(text, '^\s+|\s+$', '', 'g')), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026'), ',"words":', len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')), '}'))
  WHEN 1 THEN md5(concat('{"count":', len(m), ',"group":0,"matches":[', coalesce(array_to_string(list_transform(m, lambda x: concat('"', x, '"')), ','), ''), '],"pattern":"[A-Z][a-z]+","truncated":', CASE WHEN len(m) >= 3 THEN 'true' ELSE 'false' END, '}'))
  WHEN 2 THEN md5(concat('{"found":true,"path":"a[1].b","value":"', lang, '"}'))
  WHEN 3 THEN md5('tool text_stats error: invalid arguments')
  WHEN 4 THEN md5(concat('unknown tool: ', lang))
  ELSE md5('tool regex_extract error: pattern is required') END AS result_md5
FROM d""",
)
def dispatch_tools(t):
    k = F.col("doc_id") % 6
    doc = F.concat(F.lit('{"a":[0,{"b":"'), F.col("lang"), F.lit('"}]}'))
    calls = t("documents").select(
        "doc_id",
        F.when(k.isin(0, 3), "text_stats").when(k.isin(1, 5), "regex_extract").when(k == 2, "json_extract").otherwise(F.col("lang")).alias("name"),
        F.when(k == 0, _args(text=F.col("text")))
        .when(k == 1, _args(text=F.col("text"), pattern=F.lit("[A-Z][a-z]+"), max_matches=F.lit(3)))
        .when(k == 2, _args(json=doc, path=F.lit("a[1].b")))
        .when(k == 3, F.lit('{"text":5}'))
        .when(k == 5, _args(text=F.col("text"), pattern=F.lit(" "))).otherwise("{}").alias("args"),
    )
    return ops.dispatch_tools(calls).select("doc_id", F.md5("result").alias("result_md5"))


@query(
    "dispatch_page_tools",
    r"""SELECT page_id, md5(CASE page_id % 3 WHEN 0 THEN s
  WHEN 1 THEN 'tool web_fetch error: url must start with http:// or https://' ELSE 'tool web_fetch error: page not stored' END) AS result_md5
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(min(html) OVER (PARTITION BY url), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM pages)""",
)
def dispatch_page_tools(t):
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("ftp:"), "url")).otherwise(F.concat("url", F.lit("&unknown")))
    calls = t("pages").select("page_id", F.lit("web_fetch").alias("name"), _args(url=url).alias("args"))
    return ops.dispatch_tools(calls, t("pages").select("url", "html")).select("page_id", F.md5("result").alias("result_md5"))


@query(
    "dispatch_search_and_sql",
    r"""SELECT c_custkey, CASE c_custkey % 4
  WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 THEN concat('Answer: ', c_mktsegment, chr(10), chr(10), '- topic ', c_nationkey, chr(10), '  http://example.org/', c_nationkey) ELSE 'tool web_search error: answer not stored' END
  WHEN 1 THEN (SELECT concat('[{"n":', count(*), ',"region":"', r_name, '"}]') FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = c_custkey % 5 GROUP BY r_name)
  WHEN 2 THEN 'tool sql_query error: only SELECT or WITH … SELECT queries are allowed'
  ELSE 'tool web_search error: query is required' END AS result FROM customer""",
)
def dispatch_search_and_sql(t):
    for name in ("nation", "region"):
        t(name).createOrReplaceTempView(f"tool_{name}")
    k, customer = F.col("c_custkey"), t("customer")
    counted = "SELECT r_name AS region, count(*) AS n FROM tool_nation JOIN tool_region ON n_regionkey = r_regionkey WHERE r_regionkey = "
    statement = F.concat(F.lit(counted), (k % 5).cast("string"), F.lit(" GROUP BY r_name "))
    asked = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, statement).when(k % 4 == 2, F.concat(F.lit("DROP TABLE t"), (k % 3).cast("string"))).otherwise("")
    calls = customer.select("c_custkey", F.when(k % 4 % 3 == 0, "web_search").otherwise("sql_query").alias("name"), _args(query=asked).alias("args"))
    topic = F.array(F.struct(F.concat(F.lit("topic "), "c_nationkey").alias("text"), F.concat(F.lit("http://example.org/"), "c_nationkey").alias("url")))
    none = F.lit(None).cast("string")
    searches = customer.where(k % 8 == 0).select(F.col("c_name").alias("query"), F.col("c_mktsegment").alias("answer"), none.alias("abstract"), none.alias("source"), topic.alias("topics"))
    return ops.dispatch_tools(calls, searches=searches, most_statements=10).select("c_custkey", "result")


def _step(messages: list[dict], tools: list[str]) -> dict:
    """Ask for statistics first; records of more than 100 words ask once more."""
    last = messages[-1]
    if last["role"] == "user":
        return {"tool_calls": [{"id": "a", "name": "text_stats", "args": json.dumps({"text": last["content"]})}, {"id": "b", "name": "guess", "args": "{}"}]}
    words = json.loads(messages[3]["content"])["words"]
    if words > 100 and len(messages) < 6:
        return {"tool_calls": [{"id": "c", "name": "regex_extract", "args": json.dumps({"text": messages[1]["content"], "pattern": "[a-z]+", "max_matches": 1})}]}
    return {"content": f"{words} words, {len(messages)} messages, {last['content']}"}


@query(
    "agent_rounds",
    r"""SELECT doc_id, CASE WHEN w > 100 AND NOT regexp_matches(text, '[a-z]') THEN concat(w, ' words, 7 messages, {"count":0,"group":0,"matches":[],"pattern":"[a-z]+","truncated":false}')
  WHEN w > 100 THEN concat(w, ' words, 7 messages, {"count":1,"group":0,"matches":["', regexp_extract(text, '[a-z]+'), '"],"pattern":"[a-z]+","truncated":true}')
  ELSE concat(w, ' words, 5 messages, unknown tool: guess') END AS response, CAST(NULL AS string) AS error, CASE WHEN w > 100 THEN 3 ELSE 2 END AS rounds
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')) AS w FROM documents)""",
)
def agent_rounds(t):
    return _rounds(t, F.concat(F.lit("r"), "doc_id"))


def _rounds(t, request_id):
    asked = t("documents").select(request_id.alias("request_id"), F.lit("count").alias("system"), F.col("text").alias("user"), "doc_id")
    return rounds(asked, _step, tools=["text_stats", "regex_extract"]).select("doc_id", "response", "error", "rounds")


@query("agent_rounds_equal_ids", SQL["agent_rounds"])
def agent_rounds_equal_ids(t):
    # requests of one language share their id
    return _rounds(t, F.col("lang"))


_NAME = "concat(CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '' ELSE p_name END)"


@query("unique_names", f"SELECT DISTINCT trim({_NAME}) AS name FROM part WHERE trim({_NAME}) <> ''")
def unique_names(t):
    return ops.unique_names(t("part").withColumn("n", F.expr(_NAME)), "n")


@query(
    "unique_names_ordered",
    f"""SELECT name, p_partkey AS first_at FROM (SELECT trim({_NAME}) AS name, p_partkey FROM part WHERE trim({_NAME}) <> '')
QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) = 1""",
)
def unique_names_ordered(t):
    return ops.unique_names(t("part").withColumn("n", F.expr(_NAME)), "n", "p_partkey")
