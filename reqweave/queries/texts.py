"""Text, regex, HTML and JSON functions over whole tables."""

from pyspark.sql import functions as F

from reqweave.functions.jsonvals import json_extract as extract_path
from reqweave.functions import text as fn
from reqweave.functions.links import extract_links as page_links
from reqweave.queries.derived import ANSWER
from reqweave.queries.registry import query


@query(
    "text_stats",
    r"""SELECT doc_id, strlen(text) AS bytes, length(text) AS characters,
  length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS lines,
  len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\S'))) AS paragraphs,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda s: s <> '')) AS words,
  md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS trimmed_md5
FROM documents""",
)
def text_stats(t):
    stats = t("documents").select("doc_id", fn.text_stats(F.col("text")).alias("s"))
    return stats.select("doc_id", "s.bytes", "s.characters", "s.lines", "s.paragraphs", "s.words", F.md5("s.trimmed").alias("trimmed_md5"))


@query(
    "regex_extract",
    """SELECT doc_id, len(m) AS n, array_to_string(m, '|') AS matches, false AS truncated
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+') AS m FROM documents)""",
)
def regex_extract(t):
    found = t("documents").select("doc_id", fn.regex_extract(F.col("text"), "[A-Z][a-z]+ [a-z]+").alias("r"))
    return found.select("doc_id", F.col("r.count").alias("n"), F.array_join("r.matches", "|").alias("matches"), "r.truncated")


@query(
    "regex_extract_limit",
    """SELECT doc_id, len(m) AS n, array_to_string(m, '|') AS matches, len(m) >= 300 AS truncated
FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+')[1:300] AS m FROM documents)""",
)
def regex_extract_limit(t):
    found = t("documents").select("doc_id", fn.regex_extract(F.col("text"), "[a-z]+", max_matches=300).alias("r"))
    return found.select("doc_id", F.col("r.count").alias("n"), F.array_join("r.matches", "|").alias("matches"), "r.truncated")


# Patterns whose meaning differs between engines: ASCII classes, named groups, class names, the end of the text.
SYNTAX = {
    "words": (r"\w+", 0), "named": (r"(?P<first_word>\b[[:upper:]]\w*)\s+(?P<next>[[:alpha:]]+)", 2), "digits": (r"[[:digit:]]{2,}", 0),
    "last": (r"\S+$", 0), "lines": (r"(?m)^\w+", 0), "letters": (r"\p{Lu}\pL*", 0), "not_words": (r"[^\w\s]{2,}", 0), "any": (r"(?s:t.t)", 0), "folded": (r"(?i)der\b", 0),
}


@query(
    "regex_syntax",
    "SELECT doc_id, " + ", ".join(f"md5(array_to_string(regexp_extract_all(text, '{p}', {g}), '|')) AS {n}" for n, (p, g) in SYNTAX.items()) + " FROM documents",
)
def regex_syntax(t):
    found = {n: F.md5(F.array_join(fn.regex_extract(F.col("text"), p, g)["matches"], "|")).alias(n) for n, (p, g) in SYNTAX.items()}
    return t("documents").select("doc_id", *found.values())


@query(
    "json_extract_strict",
    """SELECT event_id, event_id % 3 = 0 AS found, CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k') END AS value FROM events""",
)
def json_extract_strict(t):
    # text after the document makes it no document
    doc = F.concat("props", F.when(F.col("event_id") % 3 == 1, " trailing").when(F.col("event_id") % 3 == 2, "{}").otherwise(" "))
    return t("events").select("event_id", extract_path(doc, "k").alias("k")).select("event_id", "k.found", "k.value")


@query(
    "regex_extract_group",
    """SELECT p_partkey, regexp_extract(p_brand, 'brand#([0-9]+)', 1, 'i') AS number, 1 AS n FROM part""",
)
def regex_extract_group(t):
    found = t("part").select("p_partkey", fn.regex_extract(F.col("p_brand"), "brand#([0-9]+)", 1, 5, True).alias("r"))
    return found.select("p_partkey", F.get("r.matches", F.lit(0)).alias("number"), F.col("r.count").alias("n"))


@query(
    "json_extract",
    """SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS found, json_extract_string(props, '$.k') AS value,
  false AS other_found FROM events""",
)
def json_extract(t):
    found = t("events").select(
        "event_id", extract_path(F.col("props"), "k").alias("k"), extract_path(F.col("props"), F.lit("k[0].z")).alias("z")
    )
    return found.select("event_id", "k.found", "k.value", F.col("z.found").alias("other_found"))


@query(
    "html_to_text",
    r"""SELECT page_id, length(s) AS chars, md5(s) AS text_md5, md5(CASE WHEN length(s) > 600 THEN concat(left(s, 600), '... [truncated]') ELSE s END) AS head_md5
FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM pages)""",
)
def html_to_text(t):
    text = fn.html_to_text(F.col("html"))
    return t("pages").select("page_id", F.length(text).cast("long").alias("chars"), F.md5(text).alias("text_md5"), F.md5(fn.html_to_text(F.col("html"), 600)).alias("head_md5"))


@query(
    "html_to_text_without_code",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""",
)
def html_to_text_without_code(t):
    return t("pages").select("page_id", F.md5(fn.strip_tags(F.col("html"), drop_code=True)).alias("text_md5"))


@query(
    "extract_links",
    """WITH refs AS (
  SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://[^/?#]+') AS site,
    list_filter(list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*[''"]([^''"#]+)[''"]', 1), lambda h: trim(h)), lambda h: h <> '') AS hrefs
  FROM pages),
each AS (SELECT page_id, scheme, site, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM refs),
links AS (
  SELECT page_id, i, CASE WHEN h LIKE 'http://%' OR h LIKE 'https://%' THEN h WHEN h LIKE '//%' THEN concat(scheme, ':', h)
    WHEN h LIKE '/%' THEN concat(site, replace(replace(replace(replace(url_encode(h), '%2F', '/'), '%2C', ','), '%3F', '?'), '%3D', '=')) END AS link
  FROM each),
firsts AS (SELECT page_id, link, min(i) AS i FROM links WHERE link IS NOT NULL GROUP BY ALL)
SELECT page_id, count(link) AS n, coalesce(string_agg(link, ' ' ORDER BY i), '') AS links
FROM pages LEFT JOIN firsts USING (page_id) GROUP BY page_id""",
)
def extract_links(t):
    links = page_links(F.col("url"), F.col("html"))
    return t("pages").select("page_id", links.alias("l")).select("page_id", F.size("l").alias("n"), F.array_join("l", " ").alias("links"))


@query(
    "truncate_text",
    """SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN concat(left(text, 500), '…') ELSE text END) AS text_md5, md5(text) AS whole_md5 FROM documents""",
)
def truncate_text(t):
    text = F.col("text")
    return t("documents").select("doc_id", F.md5(fn.truncate_text(text, 500)).alias("text_md5"), F.md5(fn.truncate_text(text)).alias("whole_md5"))


@query("sanitize_name", """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]', '_', 'g'), '^[0-9.-]', '_')) AS name_md5 FROM documents""")
def sanitize_name(t):
    return t("documents").select("doc_id", F.md5(fn.sanitize_name(F.col("text"))).alias("name_md5"))


@query(
    "strip_thinking",
    f"""SELECT event_id, CASE WHEN strpos(a, '</thinking>') > 0 THEN trim(substr(a, strpos(a, '</thinking>') + 11)) ELSE trim(a) END AS answer
FROM (SELECT event_id, {ANSWER} AS a FROM events)""",
)
def strip_thinking(t):
    return t("events").select("event_id", fn.strip_thinking(F.expr(ANSWER)).alias("answer"))


_CELL = "CASE event_id % 5 WHEN 0 THEN cast(null as string) WHEN 1 THEN '' WHEN 2 THEN concat(' ', chr(9), chr(10)) ELSE props END"


@query("is_empty_value", "SELECT event_id, event_id % 5 < 3 AS is_empty FROM events")
def is_empty_value(t):
    return t("events").select("event_id", fn.is_blank(F.expr(_CELL)).alias("is_empty"))


@query(
    "render_search_result",
    """WITH q AS (SELECT c_custkey, c_name AS query, c_custkey % 3 = 0 AS has_answer, c_custkey % 4 < 2 AS has_text, c_custkey % 4 = 0 AS has_source,
    c_custkey % 8 AS shown, c_mktsegment AS seg FROM customer),
p AS (SELECT c_custkey, query, concat_ws(chr(10) || chr(10),
    CASE WHEN has_answer THEN concat('Answer: ', seg) END,
    CASE WHEN has_text THEN concat('Summary: about ', query, CASE WHEN has_source THEN concat(chr(10), 'Source: http://example.org/', seg) ELSE '' END) END,
    CASE WHEN shown > 0 THEN array_to_string(list_transform(range(1, shown + 1), lambda i: concat('- topic ', i, CASE WHEN i % 2 = 1 THEN concat(chr(10), '  http://example.org/', i) ELSE '' END)), chr(10)) END) AS body FROM q)
SELECT c_custkey, CASE WHEN body = '' THEN concat('No results found for: ', query) ELSE body END AS result FROM p""",
)
def render_search_result(t):
    k = F.col("c_custkey")
    topics = F.expr(
        "transform(if(c_custkey % 8 = 0, cast(array() as array<bigint>), sequence(1L, c_custkey % 8)), "
        "i -> named_struct('text', concat('topic ', i), 'url', if(i % 2 = 1, concat('http://example.org/', i), '')))"
    )
    return t("customer").select(
        "c_custkey",
        fn.render_search_result(
            F.col("c_name"), F.when(k % 3 == 0, F.col("c_mktsegment")),
            F.when(k % 4 < 2, F.concat(F.lit("about "), "c_name")).otherwise(""),
            F.when(k % 4 == 0, F.concat(F.lit("http://example.org/"), "c_mktsegment")), topics,
        ).alias("result"),
    )
