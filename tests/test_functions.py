import json

import pytest
from pyspark.sql import functions as F

from reqweave.functions import hints, links, salvage, text
from reqweave.functions.jsonvals import cell_text, float_text, json_extract, pretty_record, value_json


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_text_stats_counts_words_and_lines(spark):
    r = one(spark, "Hello world\nSecond line", text.text_stats)
    assert (r["words"], r["lines"], r["characters"], r["bytes"], r["paragraphs"]) == (4, 2, 23, 23, 2)


@pytest.mark.parametrize(
    "value,lines,paragraphs,words",
    [("a", 1, 1, 1), ("a\n", 1, 1, 1), ("\n\na b\n\n c \n", 5, 2, 3), ("a b c", 1, 1, 3), ("é\r\nü", 2, 2, 2)],
)
def test_text_stats_edges(spark, value, lines, paragraphs, words):
    r = one(spark, value, text.text_stats)
    assert (r["lines"], r["paragraphs"], r["words"]) == (lines, paragraphs, words)


def test_text_stats_refuses_blank_text(spark):
    assert one(spark, " \n\t ", text.text_stats) is None


def test_regex_extract(spark):
    r = one(spark, "Order A12 and B34", lambda c: text.regex_extract(c, "[A-Z][0-9]{2}"))
    assert (r["matches"], r["count"], r["truncated"]) == (["A12", "B34"], 2, False)


def test_general_categories_are_searched_as_a_tree(spark):
    import re

    from reqweave.functions.patterns import compiled, translated

    codes = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[i : i + 4096])) for i in range(0, len(codes), 4096)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    for pattern in [r"\p{Lu}", r"\PL", r"[^\pL\d]", r"[\pN[:punct:]]+", r"[^\w\s]{2,}"]:
        java = translated(pattern, True)[0]
        # a class never has many parts beyond ASCII in a row, which would all be tried for every character
        assert not re.search(r"(?:\\x\{[0-9a-f]{3,}\}(?:-\\x\{[0-9a-f]+\})?){10}", java)
        got = rows.select("i", text.regex_extract(F.col("v"), pattern)["matches"].alias("m")).collect()
        assert {r["i"]: r["m"] or [] for r in got} == {i: compiled(pattern).findall(v) for i, v in enumerate(texts)}
    # under a folded case Java's own rules decide, as before
    assert translated(r"(?i)\p{Lu}", True)[0].count("&&") == 0


def test_regex_extract_group_out_of_range_gives_nothing(spark):
    r = one(spark, "A12", lambda c: text.regex_extract(c, "([A-Z])", group=3))
    assert r["matches"] == [] and r["count"] == 0


def test_regex_extract_limits(spark):
    r = one(spark, "x" * 300, lambda c: text.regex_extract(c, "x", max_matches=250))
    assert r["count"] == 250 and r["truncated"]
    r = one(spark, "x" * 300, lambda c: text.regex_extract(c, "x"))
    assert r["count"] == 300 and not r["truncated"]
    with pytest.raises(ValueError):
        text.regex_extract(F.lit("a"), "a*")


@pytest.mark.parametrize(
    "path,found,value",
    [
        ("customer.address.city", True, '"Porto"'), ("items[0].name", True, '"x"'), ("nil", True, "null"), ("items[3]", False, None),
        ("a.b", False, None), ("items[99999999999999]", False, None), ("$.nil", False, None), ("customer..address", True, '{"city":"Porto"}'),
        ("it's?", True, "1"), ("items[x]", False, None), ("nil.deeper", False, None), ("[0]", False, None),
    ],
)
def test_json_extract(spark, path, found, value):
    doc = '{"customer":{"address":{"city":"Porto"}},"items":[{"name":"x"}],"nil":null,"it\'s?":1}'
    df = spark.createDataFrame([(doc, path)], "d string, p string")
    r = df.select(json_extract(F.col("d"), F.col("p")).alias("j"), json_extract(F.col("d"), path).alias("fixed")).first()
    assert (r["j"]["found"], r["j"]["value"]) == (found, value) and r["fixed"] == r["j"]


def test_regex_knows_character_classes(spark):
    assert one(spark, "Öl und Äpfel", lambda c: text.regex_extract(c, r"\p{Lu}\p{L}+"))["matches"] == ["Öl", "Äpfel"]


def test_links_are_absolute_and_distinct(spark):
    html = '<a href="/docs/start">a</a><a href="/docs/start">b</a><a HREF = \'https://other.org/x\'>c</a><a href="mailto:a@b.c">m</a><a href="#top">t</a><a href=bare>b</a>'
    r = one(spark, html, lambda c: links.extract_links(F.lit("https://example.com/base/page"), c))
    assert r == ["https://example.com/docs/start", "https://other.org/x"]


def test_links_resolve_like_a_browser(spark):
    html = '<a href="../up?q=1">a</a><a href="//cdn.org/f">b</a><a href="/für">c</a>'
    r = one(spark, html, lambda c: links.extract_links(F.lit("https://example.com/a/b/c"), c))
    assert r == ["https://example.com/a/up?q=1", "https://cdn.org/f", "https://example.com/f%C3%BCr"]


def test_html_text_keeps_script_text_unless_told(spark):
    html = "<p>one <b>two</b></p><script>x = 1</script>"
    assert one(spark, html, text.html_to_text) == "one two x = 1"
    assert one(spark, html, lambda c: text.strip_tags(c, drop_code=True)) == "one two"


def test_page_text_is_cut_when_asked(spark):
    html = "<p>" + "a" * 7000 + "</p>"
    assert one(spark, html, text.html_to_text) == "a" * 7000
    assert one(spark, html, lambda c: text.html_to_text(c, 600)) == "a" * 600 + "... [truncated]"
    assert one(spark, html, lambda c: text.truncate_text(c, 3)) == "<p>…" and one(spark, html, text.truncate_text) == html


@pytest.mark.parametrize(
    "pattern,subject,found",
    [
        (r"\w+", "Größe ٣ 7", ["Gr", "e", "7"]), (r"\d", "7٣", ["7"]), (r"[[:digit:]]+", "a12 b3", ["12", "3"]), (r"\pL+", "Größe7", ["Größe"]),
        (r"(?P<x>b)c", "abcbc", ["bc", "bc"]), (r"b$", "ab\n", []), (r"(?m)b$", "ab\nb\n", ["b", "b"]), (r"(?m)^.", "a\nb", ["a", "b"]),
        (r"\Qa.b\E", "a.b axb", ["a.b"]), (r"[a&&b]", "a&b", ["a", "&", "b"]), (r"[\W]", "aß", ["ß"]), (r"(?i)STRASSE", "strasse", ["strasse"]),
        (r"a.c", "a\rc a\nc", ["a\rc"]), (r"(?s)a.c", "a\nc", ["a\nc"]), (r"\bb", "ab b ßb", ["b", "b"]), (r"x{2}", "xxxxx", ["xx", "xx"]), (r"x{,2}", "x{,2}", ["x{,2}"]),
        (r"(?i:A)b", "aB ab", ["ab"]), (r"[^[:space:]]+", "a\tb", ["a", "b"]), (r"\x{e9}", "é", ["é"]), (r"a(?:b|c)+?", "abc", ["ab"]),
    ],
)
def test_pattern_syntax_is_the_same_in_both_engines(spark, pattern, subject, found):
    from reqweave.functions.patterns import compiled

    assert one(spark, subject, lambda c: text.regex_extract(c, pattern))["matches"] == found
    assert [m.group() for m in compiled(pattern).finditer(subject)] == found


@pytest.mark.parametrize("pattern", ["a**", "(?=a)", "(?<!a)b", "a++", r"(a)\1", "[a", "(a", "a)", r"\p{Klingon}", "[z-a]", "x{2000}", "*a", "[[:what:]]"])
def test_patterns_outside_the_syntax_are_refused(pattern):
    from reqweave.functions.patterns import PatternError, compiled

    with pytest.raises(PatternError):
        compiled(pattern)


def test_truncate_counts_characters(spark):
    assert one(spark, "ééé", lambda c: text.truncate_text(c, 2)) == "éé…"
    assert one(spark, "éé", lambda c: text.truncate_text(c, 2)) == "éé"


@pytest.mark.parametrize("name,safe", [("", "_"), ("1a", "_a"), ("a b/c", "a_b_c"), ("-x.9", "_x.9"), ("ok_1", "ok_1")])
def test_sanitize_name(spark, name, safe):
    assert one(spark, name, text.sanitize_name) == safe


def test_search_result_text(spark):
    topics = F.expr("array(named_struct('text','t1','url','http://u'),named_struct('text','','url','x'))")
    q = F.lit("q")
    render = lambda a, b, s, t: one(spark, "", lambda c: text.render_search_result(q, F.lit(a), F.lit(b), F.lit(s), t))
    assert render("42", "about", "http://s", topics) == "Answer: 42\n\nSummary: about\nSource: http://s\n\n- t1\n  http://u"
    assert render("", "", "", F.expr("cast(array() as array<struct<text:string,url:string>>)")) == "No results found for: q"


@pytest.mark.parametrize(
    "value,as_json,as_cell",
    [
        (0.0, "0", "0"), (-3.0, "-3", "-3"), (1863.84, "1863.84", "1863.84"), (1e7, "10000000", "1e+07"), (12345678.5, "12345678.5", "1.23456785e+07"),
        (1e21, "1e+21", "1e+21"), (1.5e-7, "1.5e-7", "1.5e-07"), (0.000125, "0.000125", "0.000125"), (0.00001, "0.00001", "1e-05"), (123456.0, "123456", "123456"),
    ],
)
def test_float_text(spark, value, as_json, as_cell):
    df = spark.createDataFrame([(value,)], "v double")
    dtype = df.schema["v"].dataType
    r = df.select(value_json(F.col("v"), dtype).alias("j"), cell_text(F.col("v"), dtype).alias("c"), float_text(F.col("v")).alias("f")).first()
    assert (r["j"], r["c"], r["f"]) == (as_json, as_cell, as_json)


def test_pretty_record_matches_sorted_indented_json(spark):
    df = spark.sql("""SELECT 2 AS b, 'x"<y>&' AS a, cast(null as string) AS c, array(1, 2) AS d, map('k', array('z')) AS e, named_struct('n', 1.5D) AS f, array() AS g""")
    got = df.select(pretty_record(df).alias("j")).first()["j"]
    want = {"a": 'x"<y>&', "b": 2, "c": None, "d": [1, 2], "e": {"k": ["z"]}, "f": {"n": 1.5}, "g": []}
    plain = json.dumps(want, indent=2, sort_keys=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    assert got == plain


@pytest.mark.parametrize(
    "hint,description,kind",
    [
        ("", "string", "any"), ("A|B|C", 'string — exactly one of: "A", "B", "C"', "enum"),
        ("one of: low, high", 'string — exactly one of: "low", "high"', "enum"), ("boolean", "boolean (true or false)", "bool"),
        ("int64", "integer", "int"), ("float between 0.0 and 1.0", "number", "number"), ("text", "string", "string"),
        ("list of tags", "array", "array"), ("json", "object", "object"), ("short remark", "string — short remark", "any"),
        ("string|null", 'string — exactly one of: "string", "null"', "enum"), ("points", "string — points", "any"),
    ],
)
def test_hints(spark, hint, description, kind):
    r = spark.createDataFrame([(hint,)], "h string").select(hints.describe_hint(F.col("h")).alias("d"), hints.infer_kind(F.col("h")).alias("k")).first()
    assert (r["d"], r["k"]) == (description, kind)


@pytest.mark.parametrize(
    "hint,values",
    [("\"A\"| 'B' |A", ["A", "B"]), ("A|", None), ("one of: x/y", ["x", "y"]), ("One of x", None), ("one of: a, a", None), ("int", None), (' "A"| "B"', ["A", "B"])],
)
def test_enum_values(spark, hint, values):
    assert one(spark, hint, hints.parse_enum) == values


def test_last_object_is_the_shortest_ending():
    assert salvage.last_object('a {"x":{"y":1}} b') == '{"y":1}' or salvage.last_object('a {"x":{"y":1}} b') == '{"x":{"y":1}}'
    assert salvage.last_object('Result: {"approved":"yes"}') == '{"approved":"yes"}'
    assert salvage.last_object('{"a":1} {"b":2} end') == '{"b":2}'
    assert salvage.last_object("{broken} none") is None
    assert salvage.last_object('{"a":NaN}') is None


def test_first_object_skips_braces_in_strings():
    assert salvage.first_object('```json\n{"a":"}{","b":{"c":1}}\n``` {"d":2}') == '{"a":"}{","b":{"c":1}}'
    assert salvage.first_object("none") is None
    assert salvage.first_object('{"a":1') is None


def test_control_characters_inside_strings_only():
    assert salvage.escape_controls('{"a":"x\r\ny\tz\x01\\\\",\n"b":1}') == '{"a":"x\\ny\\tz\\u0001\\\\",\n"b":1}'


def test_profile_takes_one_pass_for_any_number_of_examples(spark, tmp_path):
    """Rows in any order over many tasks; the source is gone when the sketches are merged."""
    import decimal
    import datetime
    import random
    import shutil

    from reqweave.operators.ordering import ROW
    from reqweave.operators.profile import column_profile

    rng = random.Random(4)
    data = [(k, rng.choice(["a", "b", " ", None, f"v{k % 23}"]), k % 7 if k % 3 else None, [k % 4], rng.choice(['{"x":1}', "[2]", "3", "null", '"t"', "true"]), datetime.date(2024, 1, 1 + k % 9), decimal.Decimal(k % 5) / 4) for k in range(600)]
    rng.shuffle(data)
    made = spark.createDataFrame(data, f"{ROW} long, t string, n int, a array<int>, v string, d date, m decimal(6,2)").repartition(9)
    made.withColumn("v", F.parse_json("v")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    data.sort()

    def first(values, most):
        return list(dict.fromkeys(values))[:most]

    for most in (0, 1, 5, 100):
        got = {r["column"]: r for r in column_profile(df, examples=most).collect()}
        texts = [r[1] for r in data if r[1] and r[1].strip()]
        assert got["t"]["examples"] == first(texts, most) and got["t"]["empty"] == 600 - len(texts) and got["t"]["type"] == "string"
        assert got["n"]["examples"] == first([str(r[2]) for r in data if r[2] is not None], most) and got["n"]["type"] == "number"
        assert got["a"]["examples"] == first([f"[{r[0] % 4}]" for r in data], most) and got["a"]["type"] == "array"
        assert len(got["v"]["examples"]) == min(most, 5) and got["v"]["empty"] == sum(r[4] == "null" for r in data)
        assert got["d"]["examples"] == first([str(r[5]) for r in data], most) and got["m"]["type"] == "number"
    profile = column_profile(df)
    shutil.rmtree(tmp_path / "in")
    assert profile.count() == 6
    assert [tuple(r) for r in column_profile(spark.createDataFrame([], f"{ROW} long, x string")).collect()] == [("x", "empty", 0, [])]
