import pytest
from pyspark.sql import functions as F

from reqweave.functions.jsonvals import literal_fields
from reqweave.operators import answers as ops
from reqweave.operators.generate import dry_run_generate
from reqweave.operators.spec import OneJob, compile_spec, one_job, spec_frame

GRADE = {"fits": "boolean", "points": "int", "kind": "A|B|C"}
OK = {"fits": "boolean"}


def check(spark, response, schema, thinking=False):
    df = spark.createDataFrame([("job", response)], "job_id string, response string")
    parsed = ops.parse_strict(df, "response", F.lit(thinking))
    single = ops.check_answers(parsed, one_job(spec_frame(spark, schema))).select("error").first()["error"]
    many = ops.check_answers(parsed, compile_spec(spec_frame(spark, schema))).select("error").first()["error"]
    assert single == many
    return single


def test_thinking_then_object(spark):
    text = '<thinking>weigh both sides</thinking>{"fits":true,"points":3,"kind":"B"}'
    assert check(spark, text, GRADE, thinking=True) is None


def test_thinking_may_be_missing_or_fenced(spark):
    assert check(spark, '{"fits":true}', OK, thinking=True) is None
    assert check(spark, '```json\n{"fits":true}\n```', OK, thinking=True) is None
    assert check(spark, '<thinking>x</thinking>\n```\n{"fits":true}\n```', OK, thinking=True) is None


@pytest.mark.parametrize(
    "text,error",
    [
        ('Our verdict: {"fits":true}', "invalid JSON object"), ('{"fits":true} {"fits":true}', "invalid JSON object"),
        ('{"fits":true} trailing', "invalid JSON object"), ("{'fits':true}", "invalid JSON object"), ('{"fits":NaN}', "invalid JSON object"),
        ('{"fits":"a\nb"}', "invalid JSON object"), ("[true]", "invalid JSON object"), ("", "response is empty"), (None, "response is empty"),
        ('{"fits":true},"x":{"fits":true}', "invalid JSON object"), ("```\n{}```x", "invalid JSON object"), ('{"fits":01}', "invalid JSON object"),
        ("null", "response JSON keys do not match response_schema (missing: fits)"),
        ('{"a":1,"b":2}', "response JSON keys do not match response_schema (missing: fits; extra: a, b)"),
        ('{"fits":"yes"}', 'field "fits" must be boolean'), ('{"fits":null}', 'field "fits" must be boolean'),
    ],
)
def test_strict_errors(spark, text, error):
    assert check(spark, text, OK) == error


@pytest.mark.parametrize(
    "text,error",
    [
        ("<thinking>never closed", "thinking mode requires a closing </thinking> tag"),
        ("<thinking>only this</thinking> ", "missing final JSON object after </thinking>"),
        ('<thinking>a</thinking>b</thinking>{"fits":true}', "invalid JSON object"),
    ],
)
def test_thinking_errors(spark, text, error):
    assert check(spark, text, OK, thinking=True) == error


def test_last_duplicate_wins(spark):
    assert check(spark, '{"fits":"no","fits":true}', OK) is None


@pytest.mark.parametrize(
    "hint,value,good",
    [
        ("int", "3", True), ("int", "3.0", True), ("int", "3.5", False), ("int", "1e3", True), ("int", '"3"', False), ("int", "1e400", False),
        ("int", "12345678901234567890123456789012345678901234567890", True), ("number", "1.5", True), ("number", "1e400", False), ("number", "true", False),
        ("string", '"x"', True), ("string", "1", False), ("array", "[]", True), ("array", "{}", False), ("object", "{}", True), ("object", "null", False),
        ("anything goes", "null", True), ("A|B", '"A"', True), ("A|B", '"D"', False), ("A|B", "1", False), ("float between 0.0 and 1.0", "7", True),
    ],
)
def test_kinds(spark, hint, value, good):
    assert (check(spark, '{"f":%s}' % value, {"f": hint}) is None) == good


def test_enum_message(spark):
    assert check(spark, '{"kind":"D"}', {"kind": "A|B|C"}) == 'field "kind" must be one of A|B|C'
    assert check(spark, '{"kind":1}', {"kind": "A|B|C"}) == 'field "kind" must be a string enum (A|B|C)'


def test_first_field_in_name_order_is_reported(spark):
    assert check(spark, '{"b":1,"a":1}', {"b": "string", "a": "string"}) == 'field "a" must be string'


def test_lenient_takes_the_last_object_without_checks(spark):
    df = spark.createDataFrame([('Result: {"fits":"yes"}',), ("nothing",)], "response string")
    rows = ops.parse_lenient(df).select(F.try_variant_get(F.element_at("parsed", F.lit("fits")), "$", "string").alias("v"), "error").collect()
    assert [(r["v"], r["error"]) for r in rows] == [("yes", None), (None, None)]


def test_number_text_as_written(spark):
    r = spark.range(1).select(literal_fields(F.lit('{"a":3.0,"b":"x"}')).alias("m")).first()["m"]
    assert r == {"a": "3.0", "b": "x"}


def test_spread_fields_types(spark):
    df = ops.parse_strict(spark.createDataFrame([('{"a":3.0,"b":"x","c":[1],"d":true,"e":2}',)], "response string"))
    out = ops.spread_fields(df, {"a": "int", "b": "string", "c": "array", "d": "bool", "e": "number"})
    r = out.select("a", "b", F.to_json("c").alias("c"), "d", "e").first()
    assert tuple(r) == (3, "x", "[1]", True, 2.0)


def test_salvage_reads_raw_line_breaks(spark):
    df = spark.createDataFrame([('x {"task":"a\nb"} y',), ("none",)], "t string")
    rows = ops.salvage_object(df, "t").select(F.to_json("salvaged").alias("j")).collect()
    assert [r["j"] for r in rows] == ['{"task":"a\\nb"}', None]


@pytest.mark.parametrize("hint", ["A|B", "bool", "int", "number", "string hint", "list", "object", "free remark", "string"])
def test_dry_run_answers_pass_their_own_check(spark, hint):
    job = one_job(spec_frame(spark, {"f": hint, "why": "string"}))
    answer = dry_run_generate(spark.range(1), job).first()["response"]
    assert check(spark, answer, {"f": hint, "why": "string"}) is None


def test_job_without_fields_accepts_any_object(spark):
    df = ops.parse_strict(spark.createDataFrame([('{"x":1}',)], "response string"))
    assert ops.check_answers(df, OneJob()).first()["error"] is None
