"""Tools a generator may ask for, answered over a table of calls."""

from __future__ import annotations

import json
import re

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reqweave.functions.binding import let
from reqweave.functions.jsonvals import escape_markup, framed, framed_value, object_fields, value_kind, value_path
from reqweave.functions.links import extract_links
from reqweave.functions.patterns import PatternError, compiled
from reqweave.functions.text import html_to_text, is_blank, render_search_result, text_stats, trim_space
from reqweave.operators.enrich import spread_key, wanted_pages
from reqweave.operators.hotkeys import spread_join
from reqweave.storage import new_folder

# Tool names and messages.
TOOLS = ["text_stats", "regex_extract", "json_extract", "web_fetch", "web_extract_links", "web_search", "sql_query"]
PAGE_TOOLS = ["web_fetch", "web_extract_links"]
READ_ONLY = "only SELECT or WITH … SELECT queries are allowed"


def _writes(spark: SparkSession, text: str) -> bool:
    """True if the statement holds an insert or any other command, by its parsed plan; nothing is run."""
    try:
        plan = spark.sql("EXPLAIN EXTENDED " + text).first()[0]
    except AnalysisException:
        plan = ""
    if "== Parsed Logical Plan ==" not in plan:  # it cannot run either; its own error is shown unless it tried to write
        return re.search(r"(?i)\)\s*(INSERT|DELETE|UPDATE|MERGE)\b", text) is not None
    parsed = plan.partition("== Parsed Logical Plan ==")[2].partition("== Analyzed Logical Plan ==")[0]
    nodes = re.findall(r"(?m)^[\s:+\-'!]*([A-Z]\w+)", parsed)
    return any(n.startswith("Insert") or n.endswith(("Statement", "Command", "AsSelect")) for n in nodes)


def sql_query(spark: SparkSession, query: str) -> DataFrame:
    """Run one read-only statement over the registered views."""
    text = query.strip()
    if not text:
        raise ValueError("query is required")
    if not text.upper().startswith(("SELECT", "WITH")) or (text.upper().startswith("WITH") and _writes(spark, text)):
        raise ValueError(READ_ONLY)
    return spark.sql(text)


def sql_answer(spark: SparkSession, query: str, limit: int = 0) -> DataFrame:
    """The tool's answer: the rows of the result, or the first ``limit``, as one JSON array.

    An answer is one text value, so statements with big results need a limit.
    """
    rows = sql_query(spark, query)
    rows = rows.limit(limit) if limit > 0 else rows
    cells = F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    listed = F.to_json(F.collect_list(cells), {"ignoreNullFields": "false"})
    return rows.agg(F.when(F.count("*") == 0, "null").otherwise(escape_markup(listed)).alias("answer"))


def _one_regex(text, pattern, group, limit, fold):
    try:
        found = compiled(pattern.strip(), fold)
    except PatternError as e:
        return None, f"compile pattern: {e}"
    group = max(group, 0)
    matches, raw, end = [], 0, -1
    for m in found.finditer(text):
        # an empty match right after a match does not count
        if m.end() == m.start() == end:
            continue
        end, raw = m.end(), raw + 1
        if group <= found.groups:
            matches.append(m.group(group) or "")
        if raw == limit:
            break
    out = {
        "count": len(matches), "group": group, "matches": matches, "pattern": pattern,
        "truncated": 0 < limit <= len(matches),
    }
    return json.dumps(out, ensure_ascii=False, separators=(",", ":")), None


@F.pandas_udf(T.StructType().add("result", "string").add("error", "string"))
def _regex_calls(text: pd.Series, pattern: pd.Series, group: pd.Series, limit: pd.Series, fold: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None) if t is None or p is None else _one_regex(t, p, int(g), int(n), bool(f))
        for t, p, g, n, f in zip(text, pattern, group, limit, fold)
    ]
    return pd.DataFrame(rows, columns=["result", "error"])


# The arguments of each tool, their JSON kind, column type and default.
ARGUMENTS = {
    "text_stats": [("text", "string", "string", "")],
    "regex_extract": [
        ("text", "string", "string", ""), ("pattern", "string", "string", ""), ("group", "number", "int", 0),
        ("max_matches", "number", "int", 0), ("case_insensitive", "bool", "boolean", False),
    ],
    "json_extract": [("json", "string", "string", ""), ("path", "string", "string", "")],
    "web_fetch": [("url", "string", "string", "")],
    "web_extract_links": [("url", "string", "string", ""), ("max_links", "number", "int", 0)],
    "web_search": [("query", "string", "string", "")],
    "sql_query": [("query", "string", "string", "")],
}


def _with_arguments(calls: DataFrame, active: list[str]) -> DataFrame:
    """Adds the arguments of the active tools, each read once, and ``_problem``."""
    wanted = {a[0]: a for tool in active for a in ARGUMENTS[tool]}
    known = F.col("name").isin(active)
    out = calls.withColumn("_frame", framed(F.when(known, F.col("args"))))
    out = out.withColumn("_args", object_fields(framed_value(F.col("_frame"))))
    member = lambda name: F.element_at("_args", F.lit(name))
    values = {f"_{n}": F.coalesce(F.try_variant_get(member(n), "$", sql), F.lit(default)) for n, _, sql, default in wanted.values()}
    kinds = {f"_{n}_kind": value_kind(member(n)) for n in wanted}
    out = out.withColumns({**values, **kinds})
    wrong = F.col("_args").isNull()
    for tool in active:
        for n, kind, _, _ in ARGUMENTS[tool]:
            wrong = wrong | ((F.col("name") == tool) & ~F.coalesce(F.col(f"_{n}_kind").isin(kind, "null"), F.lit(True)))
    return out.withColumn("_problem", F.when(known & wrong, "invalid arguments"))


def _asked_links(calls: DataFrame) -> DataFrame:
    """Addresses the calls of page tools name; whether a call is valid is checked later."""
    args = F.when(F.col("name").isin(PAGE_TOOLS), F.try_parse_json("args"))
    return calls.select(F.try_variant_get(args, "$.url", "string").alias("link"))


def stored_searches(searches: DataFrame, asked: DataFrame) -> DataFrame:
    """``_searched, _found``: the stored answer to each asked query as text; answers nobody asked for are dropped first."""
    wanted = asked.where(F.col("_query") != "").select(F.col("_query").alias("_searched")).distinct()
    kept = searches.join(wanted, searches["query"] == wanted["_searched"])
    text = render_search_result(F.col("_searched"), F.col("answer"), F.col("abstract"), F.col("source"), F.col("topics"))
    return kept.select("_searched", text.alias("_found")).groupBy("_searched").agg(F.min("_found").alias("_found"))


def statement_answers(asked: DataFrame, most: int, rows: int = 0) -> DataFrame:
    """``_statement, _answer, _refused`` per distinct statement, each planned and run once.

    More than ``most`` different statements are an error, because each is a query of its own. An answer holds all
    rows or the first ``rows``; answers are written where they are made, and what went wrong with a statement becomes its text.
    """
    spark = asked.sparkSession
    found = asked.where(F.col("_query") != "").select(trim_space(F.col("_query")).alias("s")).where("s <> ''").distinct().orderBy("s").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} different statements; raise most_statements or run them as queries of their own")
    folder, refused = new_folder(spark, "statements"), []
    spark.createDataFrame([], "_statement string, _answer string").write.parquet(folder)
    for r in found:
        try:
            sql_answer(spark, r["s"], rows).select(F.lit(r["s"]).alias("_statement"), F.col("answer").alias("_answer")).write.mode("append").parquet(folder)
        except ValueError as e:
            refused.append((r["s"], str(e)))
        except (PySparkException, Py4JJavaError) as e:
            refused.append((r["s"], "execute query: " + str(e).strip().split("\n")[0]))
    done = spark.read.parquet(folder).withColumn("_refused", F.lit(None).cast("string"))
    return done.unionByName(spark.createDataFrame(refused, "_statement string, _refused string"), allowMissingColumns=True)


def dispatch_tools(
    calls: DataFrame, pages: DataFrame | None = None, enabled: list[str] = TOOLS, page_chars: int = 0,
    searches: DataFrame | None = None, most_statements: int = 0, statement_rows: int = 0,
) -> DataFrame:
    """``calls(.., name, args)`` plus ``result``; problems become result text.

    Page texts are whole, or cut after ``page_chars``.

    Page tools read the stored ``pages(url, html)``, ``web_search`` the stored ``searches(query, answer, abstract,
    source, topics)``. ``sql_query`` answers at most ``most_statements`` different statements (none if 0) over the session's
    views; read all columns of ``calls`` from a written table then. Only calls of the regex tool
    hand their texts to Python, because each row brings its own pattern.
    """
    there = {**dict.fromkeys(PAGE_TOOLS, pages is not None), "web_search": searches is not None, "sql_query": most_statements > 0}
    active = [t for t in enabled if t in TOOLS and there.get(t, True)]
    name, known = F.col("name"), F.col("name").isin(active)
    is_tool = lambda tool: (name == tool) & F.col("_problem").isNull()
    out, problem, result = _with_arguments(calls, active), F.lit(None).cast("string"), F.lit(None).cast("string")
    if "text_stats" in active:
        problem = F.when(is_tool("text_stats") & is_blank(F.col("_text")), "text is required").otherwise(problem)
        result = F.when(is_tool("text_stats"), let(F.col("_text"), lambda x: F.to_json(text_stats(x)))).otherwise(result)
    if "regex_extract" in active:
        usable = is_tool("regex_extract") & ~is_blank(F.col("_text")) & ~is_blank(F.col("_pattern"))
        given = lambda column: F.when(usable, F.col(column))
        out = out.withColumn("_rx", _regex_calls(given("_text"), given("_pattern"), F.col("_group"), F.col("_max_matches"), F.col("_case_insensitive")))
        refused = F.when(is_blank(F.col("_text")), "text is required").when(is_blank(F.col("_pattern")), "pattern is required").otherwise(F.col("_rx.error"))
        problem = F.when(is_tool("regex_extract"), refused).otherwise(problem)
        result = F.when(is_tool("regex_extract"), F.col("_rx.result")).otherwise(result)
    if "json_extract" in active:
        doc, path = F.col("_json"), F.col("_path_arg")
        out = out.withColumnRenamed("_path", "_path_arg").withColumn("_doc_frame", framed(F.when(is_tool("json_extract") & ~is_blank(doc), doc)))
        out = out.withColumn("_doc", framed_value(F.col("_doc_frame")))
        found = F.try_variant_get(F.col("_doc"), let(path, value_path), "variant")
        shown = let(found, lambda v: F.struct(v.isNotNull().alias("found"), path.alias("path"), v.alias("value")))
        refused = F.when(is_blank(doc), "json is required").when(is_blank(path), "path is required").when(F.col("_doc").isNull(), "parse json")
        problem = F.when(is_tool("json_extract"), refused).otherwise(problem)
        result = F.when(is_tool("json_extract"), F.to_json(shown, {"ignoreNullFields": "false"})).otherwise(result)
    result = escape_markup(result)
    web = [t for t in active if t in PAGE_TOOLS]
    if web:
        url, is_web = F.col("_url"), name.isin(web) & F.col("_problem").isNull()
        stored = wanted_pages(pages, _asked_links(calls))
        out = out.withColumn("_asked_url", spread_key(F.when(is_web, F.nullif(url, F.lit("")))))
        out = spread_join(out.withColumn("_linked", F.when(is_web, F.nullif(url, F.lit("")))), stored, "_asked_url", "_page", "_linked")
        problem = F.coalesce(
            problem,
            F.when(is_web & (url == ""), "url is required")
            .when(is_web & ~(url.startswith("http://") | url.startswith("https://")), "url must start with http:// or https://")
            .when(is_web & F.col("_html").isNull(), "page not stored"),
        )
        result = F.when(is_tool("web_fetch"), html_to_text(F.col("_html"), page_chars)).otherwise(result)
        if "web_extract_links" in web:
            every = extract_links(F.col("_page"), F.col("_html"))
            links = let(every, lambda x: F.when(F.col("_max_links") > 0, F.slice(x, F.lit(1), F.greatest("_max_links", F.lit(1)))).otherwise(x))
            result = F.when(is_tool("web_extract_links"), escape_markup(F.to_json(links))).otherwise(result)
    if "web_search" in active:
        query = F.when(is_tool("web_search"), F.nullif(F.col("_query"), F.lit("")))
        found = stored_searches(searches, out.where(is_tool("web_search")).select("_query"))
        out = spread_join(out.withColumn("_asked_query", query).withColumn("_search_key", spread_key(query)), found, "_search_key", "_searched", "_asked_query")
        refused = F.when(F.col("_query") == "", "query is required").when(F.col("_found").isNull(), "answer not stored")
        problem = F.when(is_tool("web_search"), refused).otherwise(problem)
        result = F.when(is_tool("web_search"), F.col("_found")).otherwise(result)
    if "sql_query" in active:
        text = trim_space(F.col("_query"))
        found = statement_answers(out.where(is_tool("sql_query")).select("_query"), most_statements, statement_rows)
        statement = F.when(is_tool("sql_query"), F.nullif(text, F.lit("")))
        out = spread_join(out.withColumn("_asked_statement", statement).withColumn("_statement_key", spread_key(statement)), found, "_statement_key", "_statement", "_asked_statement")
        problem = F.when(is_tool("sql_query"), F.when(text == "", "query is required").otherwise(F.col("_refused"))).otherwise(problem)
        result = F.when(is_tool("sql_query"), F.col("_answer")).otherwise(result)
    problem = F.coalesce("_problem", F.when(known, problem))
    shown = (
        F.when(~known, F.concat(F.lit("unknown tool: "), name))
        .when(problem.isNotNull(), F.concat(F.lit("tool "), name, F.lit(" error: "), problem))
        .otherwise(result)
    )
    return out.select(*calls.columns, shown.alias("result"))


def unique_names(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Trimmed, non-empty, distinct names.

    Without ``order`` names differ by case; with it the first spelling of each name
    wins, whatever its case. Aggregates only, so a frequent name is no hot spot.
    """
    named = df.select(trim_space(F.col(column)).alias("name"), *([order] if order else [])).where(F.col("name") != "")
    if order is None:
        return named.distinct()
    return named.groupBy(F.lower("name").alias("_key")).agg(
        F.min_by("name", order).alias("name"), F.min(order).alias("first_at")
    ).drop("_key")


def distinct_in_order(names: Column) -> Column:
    """The array form: trimmed, non-empty, first occurrence wins, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, trim_space), lambda n: n != "")))
