import glob
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reqweave.operators import merge, prompts
from reqweave.operators.dialects import build_request_payload, extract_response_text
from reqweave.operators.profile import column_profile
from reqweave.operators.ordering import ROW
from reqweave.operators.retry import retry_after_seconds, retry_delay
from reqweave.operators.tools import dispatch_tools, distinct_in_order, sql_answer, sql_query
from reqweave.sinks import files as sinks
from reqweave.sinks.tables import sink_sql
from reqweave.sinks.workbooks import build_workbooks, sink_xlsx, workbook_bytes
from reqweave.sources import files as src
from reqweave.sources.tables import jdbc_options
from reqweave.sources.workbooks import named_rows, scan_xlsx, workbook_columns
from reqweave.streaming.watch import run_per_file, watch_folder


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- text files (blocks of files: test_blocks.py) ---------------------------------
def test_csv_sink_quotes_what_its_reader_needs(spark, tmp_path):
    df = spark.sql("SELECT array(struct(7 AS depth)) AS layers, '  ' AS pad, cast(null as double) AS none, 'say \"no\"' AS said, 'two\nlines' AS note")
    out = str(tmp_path / "out")
    sinks.sink_csv(df, out, "|")
    assert open(glob.glob(out + "/part-*")[0]).read() == 'layers|pad|none|said|note\n"[{""depth"":7}]"|  ||"say ""no"""|"two\nlines"\n'
    back = src.scan_csv(spark, out, "|")
    assert rows(back) == [('[{"depth":7}]', "  ", "", 'say "no"', "two\nlines")]


def test_union_of_frames_with_other_columns(spark):
    a, b = spark.sql("SELECT 3L AS sku, 0.5 AS share"), spark.sql("SELECT array('k') AS tags, 4L AS sku")
    df = merge.union_columns([a, b])
    assert df.columns == ["share", "sku", "tags"] and [(r["sku"], r["tags"]) for r in df.orderBy("sku").collect()] == [(3, None), (4, ["k"])]


def test_preview_tolerates_bad_lines(spark, tmp_path):
    path = put(tmp_path, "log.jsonl", '[]\n{"at":"08:15","kind":{"p":[1]}}\n{"at":\n\n{}\n"x"\n')
    assert src.tolerant_preview(spark, path).count() == 2
    sheet = put(tmp_path, "sheet.tsv", 'bin\tcontents\nB-7\t"nuts;\nbolts"\nB-8\tempty\n')
    assert rows(src.tolerant_preview(spark, sheet, 1)) == [("B-7", "nuts;\nbolts")]
    assert rows(src.tolerant_preview(spark, sheet)) == [("B-7", "nuts;\nbolts"), ("B-8", "empty")]


def test_json_documents_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [(None, 9)], "g string, i long")
    got = {(r["g"], r["part"]): json.loads(r["document"]) for r in sinks.json_documents(df, "g", ["i"], 2).collect()}
    assert got == {
        ("a", 0): [{"g": "a", "i": 0}, {"g": "a", "i": 1}], ("a", 1): [{"g": "a", "i": 2}, {"g": "a", "i": 3}],
        ("a", 2): [{"g": "a", "i": 4}], (None, 0): [{"g": None, "i": 9}],
    }


def test_parts_are_bounded_by_bytes(spark):
    import random

    from reqweave.operators import ordering

    rng = random.Random(3)
    sizes = {g: [rng.choice([10, 200, 3000, 100_000]) for _ in range(n)] for g, n in (("a", 700), ("b", 3), (None, 40))}
    df = spark.createDataFrame([(g, k, "x" * s) for g, own in sizes.items() for k, s in enumerate(own)], "g string, k int, t string").repartition(5)
    before, ordering.RUN_ROWS = ordering.RUN_ROWS, 16
    try:
        got = ordering.parts_in_group(df, "g", ["k"], F.octet_length("t"), 120_000, 50).select("g", "k", "_group_idx", "_part", F.length("t").alias("n")).collect()
    finally:
        ordering.RUN_ROWS = before
    assert len(got) == 743 and all(r["k"] == r["_group_idx"] for r in got)
    for g in sizes:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["k"])
        assert [r["n"] for r in own] == sizes[g] and [r["_part"] for r in own] == sorted(r["_part"] for r in own)
        for part in {r["_part"] for r in own}:
            rows_ = [r["n"] for r in own if r["_part"] == part]
            assert sum(rows_) < 120_000 + rows_[0] and len(rows_) <= 50
    assert len({r["_part"] for r in got if r["g"] == "a"}) > 50
    short = ordering.parts_in_group(df, "g", ["k"], F.lit(1), 10**9, 7).collect()
    assert all(r["_part"] == r["_group_idx"] // 7 for r in short)
    books = sorted(r["rows"] for r in build_workbooks(df.where("g = 'b'"), "g", ["k"], bytes_per_book=500).collect())
    assert sum(books) == 3


def test_jsonl_sink_keeps_nulls_and_sorts_keys(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.sink_jsonl(spark.sql("SELECT 'x<' AS b, cast(null as string) AS a"), out)
    assert open(glob.glob(out + "/part-*")[0]).read() == '{"a":null,"b":"x\\u003c"}\n'


# --- XML, workbooks, tables -------------------------------------------------------
def test_xml_records_at_any_depth(spark, tmp_path):
    text = """<log><day n="1"><event at="08:15"><sensor unit="C">21.5</sensor><flag>on</flag></event></day>
    <event at="09:00"><flag>a</flag><flag>b &amp; c</flag></event></log>"""
    df = src.scan_xml(spark, put(tmp_path, "log.xml", text), "event")
    assert rows(df.select("`@at`", "sensor.`#text`", "sensor.`@unit`", "flag")) == [("08:15", "21.5", "C", ["on"]), ("09:00", None, None, ["a", "b & c"])]
    with pytest.raises(ValueError):
        src.scan_xml(spark, "x", "")


def test_xml_sink_leaves_nulls_out(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.sink_xml(spark.sql("SELECT 'v' AS `a b`, cast(null as string) AS c, '1' AS `_d`"), out)
    text = open(glob.glob(out + "/part-*")[0]).read()
    assert "<a_b>v</a_b>" in text and "<_d>1</_d>" in text and "<c>" not in text


def test_workbook_rows_headers_and_gaps():
    book = workbook_bytes(["shelf", ""], [["", "3 < 4"], ["", ""], ["top", "", "beyond"]])
    assert named_rows(book, True) == [
        (0, {"shelf": "", "col_2": "3 < 4", "col_3": ""}), (1, {"shelf": "top", "col_2": "", "col_3": "beyond"}),
    ]
    assert named_rows(book, False)[0][1] == {"col_1": "shelf", "col_2": "", "col_3": ""}


def test_workbook_cells_keep_every_character():
    texts = ["a\x0bb\x00", "_x000B_", "line\r\nbreak\tTab", "<&>\uffff", "_x_"]
    (row,) = named_rows(workbook_bytes(["t1", "t2", "t3", "t4", "t5"], [texts]), True)
    assert list(row[1].values()) == texts
    with pytest.raises(ValueError, match="32767"):
        workbook_bytes(["t"], [["x" * 32_768]])


def test_workbook_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "g string, v string")
    sink_xlsx(df, str(tmp_path), "g", ["v"], 1)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a-00000.xlsx", "a-00001.xlsx", "b-00000.xlsx"]
    back = workbook_columns(scan_xlsx(spark, str(tmp_path)), ["g", "v", "none"])
    assert sorted(rows(back.select("g", "v", "none"))) == [("a", "1", ""), ("a", "3", ""), ("b", "2", "")]


def test_jdbc_options():
    assert jdbc_options("jdbc:x", query='select "n" from items') == {"url": "jdbc:x", "query": 'select "n" from items'}
    many = jdbc_options("jdbc:x", table="t", partition={"column": "id", "lower": 0, "upper": 9, "parts": 3}, fetchsize=10)
    assert many["numPartitions"] == "3" and many["dbtable"] == "t" and many["fetchsize"] == "10"
    for bad in [{}, {"query": "q", "table": "t"}, {"query": "q", "partition": {"column": "c", "lower": 0, "upper": 1, "parts": 1}}]:
        with pytest.raises(ValueError):
            jdbc_options("jdbc:x", **bad)


def test_table_sink_needs_url_and_table(spark):
    with pytest.raises(ValueError):
        sink_sql(spark.range(1), "", "t")


@pytest.mark.parametrize("path,want", [("d/out.csv", "d/out.job-7.csv"), ("out.job-3.csv", "out.job-7.csv"), ("/a.b/out", "/a.b/out.job-7"), ("/x.json", "/x.job-7.json")])
def test_run_scoped_path(path, want):
    assert sinks.run_scoped_path(path, 7) == want


@pytest.mark.parametrize("format", ["jsonl", "csv", "tsv", "xml"])
def test_export(spark, tmp_path, format):
    stored, out = str(tmp_path / "stored"), str(tmp_path / "out")
    sinks.sink_jsonl(spark.sql("SELECT 1 AS b, 'x' AS a"), stored)
    sinks.export_convert(spark, stored, out, format)
    assert glob.glob(out + "/part-*")
    with pytest.raises(ValueError):
        sinks.export_convert(spark, stored, out, "pdf")


def test_file_formats(spark, tmp_path):
    put(tmp_path, "a.csv", "x;y\n1;2\n")
    put(tmp_path, "b.json", " [1]")
    put(tmp_path, "c.txt", "{}")
    got = {r["path"].rsplit("/", 1)[1]: (r["type"], r["sniffed"]) for r in src.file_formats(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("csv", ";"), "b.json": ("json", ","), "c.txt": ("jsonl", ",")}
    names = src.file_inventory(spark, [str(tmp_path)])
    assert sorted(rows(names.select("name", "size"))) == [("a.csv", 8), ("b.json", 4), ("c.txt", 2)]


# --- prompts, calls, tools ----------------------------------------------------------
def body(spark, sql, template):
    df = spark.sql(sql)
    return prompts.record_body(df, template).first()["_body"]


def test_record_body_forms(spark):
    row = "SELECT 'Al' AS name, '{\"b\":[1.0],\"a\":\"<\"}' AS doc, '' AS empty"
    assert body(spark, row, "Hello {{ .name }}") == '{\n  "input": "Hello Al"\n}'
    assert json.loads(body(spark, row, "{{ .empty }}")) == {"name": "Al", "doc": '{"b":[1.0],"a":"<"}', "empty": ""}
    assert body(spark, row, "{{ .doc }}").startswith('{\n  "a": "\\u003c",\n  "b": [')
    assert body(spark, row, "{{.missing}}") == '{\n  "input": "\\u003cno value\\u003e"\n}'
    assert body(spark, "SELECT 'shadow' AS record", "{{ .record }}") == '{\n  "input": "shadow"\n}'
    with pytest.raises(ValueError):
        prompts.Template.compile("{{ if .x }}a{{ end }}")


def test_envelopes_and_payloads(spark):
    cached = spark.range(1).select(build_request_payload("messages", F.lit("S"), F.lit("U"), "m", cache=True).alias("b")).first()["b"]
    assert json.loads(cached) == {
        "model": "m", "system": [{"type": "text", "text": "S", "cache_control": {"type": "ephemeral"}}],
        "messages": [{"role": "user", "content": "U"}], "max_tokens": 1024,
    }
    bad = spark.range(1).select(extract_response_text("chat", F.lit("<html>")).alias("r")).first()["r"]
    assert bad["text"] is None and bad["error"] == "decode response"
    with pytest.raises(ValueError):
        build_request_payload("telepathy", F.lit(""), F.lit(""), "m")


def test_waits(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    r = spark.range(1).select(
        retry_after_seconds(F.lit("7"), now).alias("a"), retry_after_seconds(F.lit("Mon, 01 Jan 2024 00:01:30 GMT"), now).alias("b"),
        retry_after_seconds(F.lit("soon"), now).alias("c"), retry_delay(F.lit(1), F.lit(True), F.lit(0)).alias("d"),
        retry_delay(F.lit(1), F.lit(True), F.lit(60)).alias("e"), retry_delay(F.lit(9), F.lit(False), F.lit(60)).alias("f"),
    ).first()
    assert tuple(r) == (7, 90, 0, 5, 60, 32)


def test_tool_problems_become_text(spark):
    calls = [
        (1, "regex_extract", '{"text":"aab","pattern":"a*"}'), (2, "regex_extract", '{"text":"x","pattern":"("}'), (3, "json_extract", '{"json":"{} x","path":"a"}'),
        (4, "json_extract", '{"json":"[{\\"a\\":null}]","path":"[0].a"}'), (5, "text_stats", "broken"), (6, "web_fetch", '{"url":"http://x"}'), (7, "text_stats", '{"text":" "}'),
    ]
    got = {r["id"]: r["result"] for r in dispatch_tools(spark.createDataFrame(calls, "id long, name string, args string")).collect()}
    assert json.loads(got[1])["matches"] == ["aa", ""]
    assert got[2].startswith("tool regex_extract error: compile pattern")
    assert got[3] == "tool json_extract error: parse json"
    assert json.loads(got[4]) == {"found": True, "path": "[0].a", "value": None}
    assert got[5] == "tool text_stats error: invalid arguments" and got[6] == "unknown tool: web_fetch" and got[7] == "tool text_stats error: text is required"


def test_searches_and_statements_as_tools(spark):
    spark.createDataFrame([(4, "oak"), (2, "elm")], "age int, kind string").createOrReplaceTempView("trees")
    said = lambda q: json.dumps({"query": q})
    calls = [
        (1, "sql_query", said("SELECT kind FROM trees ORDER BY kind")), (2, "sql_query", said(" SELECT kind FROM trees ORDER BY kind ")), (3, "sql_query", said("DELETE FROM trees")),
        (4, "sql_query", said("SELECT nothing FROM trees")), (5, "sql_query", said(" ")), (6, "sql_query", "{"), (7, "sql_query", said("SELECT raise_error('late') AS x")),
        (8, "web_search", said("elm")), (9, "web_search", said("ash")), (10, "web_search", said("")), (11, "text_stats", '{"text":"x"}'), (12, "sql_query", said("SELECT 1 AS a WHERE false")),
    ]
    df = spark.createDataFrame(calls, "id long, name string, args string")
    searches = spark.sql("SELECT 'elm' AS query, 'a tree' AS answer, '' AS abstract, '' AS source, array(named_struct('text', 'bark', 'url', 'http://b')) AS topics")
    got = {r["id"]: r["result"] for r in dispatch_tools(df, searches=searches, most_statements=5).collect()}
    assert got[1] == got[2] == '[{"kind":"elm"},{"kind":"oak"}]' and got[12] == "null"
    assert got[3] == "tool sql_query error: only SELECT or WITH … SELECT queries are allowed" and got[5] == "tool sql_query error: query is required"
    assert got[4].startswith("tool sql_query error: execute query: [UNRESOLVED_COLUMN") and got[6] == "tool sql_query error: invalid arguments"
    assert got[7].startswith("tool sql_query error: execute query:") and got[8] == "Answer: a tree\n\n- bark\n  http://b"
    assert got[9] == "tool web_search error: answer not stored" and got[10] == "tool web_search error: query is required" and '"words":1' in got[11]
    off = {r["id"]: r["result"] for r in dispatch_tools(df).collect()}
    assert off[1] == "unknown tool: sql_query" and off[8] == "unknown tool: web_search"
    with pytest.raises(ValueError, match="more than 2"):
        dispatch_tools(df, most_statements=2)


def test_sql_tool_is_read_only(spark):
    spark.createDataFrame([(4, "oak"), (2, "elm"), (4, "ash")], "age int, kind string").createOrReplaceTempView("trees")
    grouped = "\n\tselect age, max(kind) AS last FROM trees GROUP BY age ORDER BY age DESC"
    assert sql_answer(spark, grouped).first()["answer"] == '[{"age":4,"last":"oak"},{"age":2,"last":"elm"}]'
    assert sql_answer(spark, "SELECT kind FROM trees WHERE age > 90").first()["answer"] == "null"
    assert sql_answer(spark, grouped, 1).first()["answer"] == '[{"age":4,"last":"oak"}]'
    assert sql_query(spark, "WITH old AS (SELECT kind FROM trees WHERE age = 4) SELECT 'InsertInto' AS a, count(*) AS n FROM old").first()["n"] == 2
    for bad in ["", "TRUNCATE TABLE trees", "Update trees SET age = 1", "WITH q AS (SELECT 1 AS a, 'b' AS b) INSERT INTO trees SELECT a, b FROM q"]:
        with pytest.raises(ValueError):
            sql_query(spark, bad)


def test_distinct_in_order(spark):
    r = spark.range(1).select(distinct_in_order(F.array(*map(F.lit, [" b", "a", "", "b ", "A"]))).alias("r")).first()["r"]
    assert r == ["A", "a", "b"]


def test_profile(spark):
    df = spark.createDataFrame([(0, 1.0, True, ""), (1, 2.0, False, "ready")], f"{ROW} long, id double, active boolean, note string")
    got = {r["column"]: (r["type"], r["empty"], r["examples"]) for r in column_profile(df).collect()}
    assert got == {"id": ("number", 0, ["1", "2"]), "active": ("bool", 0, ["true", "false"]), "note": ("string", 1, ["ready"])}


# --- streams -------------------------------------------------------------------------
def test_every_file_is_one_job_and_read_once(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    (inbox / "sub").mkdir()
    put(inbox, "a.csv", "id\n1\n2\n")
    put(inbox, "ignored.txt", "id\n9\n")
    put(inbox / "sub", "deep.csv", "id\n8\n")

    def run():
        stream = watch_folder(spark, str(inbox), "id long")
        run_per_file(stream, lambda b: b.withColumn("twice", F.col("id") * 2), out, check, once=True).awaitTermination()

    run()
    put(inbox, "b.csv", "id\n3\n")
    run()
    run()
    got = spark.read.parquet(out).orderBy("id").select("id", "twice", "file_name")
    assert rows(got) == [(1, 2, "a.csv"), (2, 4, "a.csv"), (3, 6, "b.csv")]


def test_places_of_documents_are_summed_without_the_documents(spark):
    from reqweave.queries import QUERIES

    found = QUERIES["sink_json_bytes"](spark, "/root/testdata/sf0.001")
    # a window over the documents themselves would bring all those of a language to one task
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    places = {(r["lang"], r["place"]) for r in found.select("lang", "place").collect()}
    sizes = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    assert places == {(lang, k) for lang, n in sizes.items() for k in range(n)}


def test_an_envelope_is_read_once_for_all_that_is_looked_up_in_it(spark):
    from reqweave.operators.dialects import DIALECTS, extract_tool_calls

    rows = spark.range(1).select(F.concat(F.lit("{}"), F.lit(" ")).alias("body"))
    for dialect in DIALECTS:
        plan = rows.select(extract_response_text(dialect, F.col("body")).alias("r"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("from_json(") == 1
    for dialect in ("chat", "messages"):
        plan = rows.select(extract_tool_calls(dialect, F.col("body")).alias("r"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("from_json(") == 1
