"""CSV records and JSON objects of files that are cut into blocks at any byte."""

import csv
import io
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from reqweave.config import job_config
from reqweave.operators.ordering import ROW, number_arrival
from reqweave.plans.job import number_input, read_input
from reqweave.sources import files as src
from reqweave.sources.arrays import effect
from reqweave.sources.records import ends_inside


@pytest.fixture
def blocks(spark):
    """Sets the size of blocks; the session's own sizes come back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def ordered(df):
    return [tuple(r[3:]) for r in df.orderBy("_src", "_block", "_place").collect()]


@pytest.mark.parametrize(
    ("line", "inside", "want"),
    [
        ("", False, False), ("", True, True), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True), ('a,"b"""', False, False), ('a"b,c', False, False), ('"', False, True),
        ('"', True, False), ('""', True, True), ('",x,"', True, True), ('x"y,"z', True, True), ('x",y"z', True, False), ('"a"b,"c', False, True), ('"a"b"c', False, False), (',,"",', False, False),
    ],
)
def test_where_a_line_ends(line, inside, want):
    assert ends_inside(line, ",", inside) is want


CELLS = ["", "7", "a,b", "one\ntwo", 'q"q', '"', '""', "\n", '\n\n"', "x\r\ny", ",", '3" pipe', "ééé", 'end"\n', " pad "]


@pytest.mark.parametrize(("size", "end"), [(40, "\n"), (150, "\r\n"), (100_000, "\n")])
def test_records_whatever_the_blocks(spark, tmp_path, blocks, size, end):
    rng = random.Random(size)
    data = [[rng.choice(CELLS) for _ in range(3)] + [str(k)] for k in range(50)]
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([["left", "mid\ndle", "a,b", "k"], *data])
    put(tmp_path, "a.csv", "﻿" + text.getvalue())
    put(tmp_path, "b.csv", 'left,"mid\ndle","a,b",k\n\nragged,1\nlazy,a"b,c""d,e\n\r\n1,2,3,4,5')
    blocks(size)
    df = src.scan_csv(spark, str(tmp_path), ",", placed=True)
    assert df.columns[3:] == ["left", "mid\ndle", "a,b", "k"]
    assert ordered(df) == [tuple(r) for r in data] + [("ragged", "1", "", ""), ("lazy", 'a"b', 'c""d', "e"), ("1", "2", "3", "4")]
    if size < 1000:
        assert df.select("_src", "_block").distinct().count() > 5


def test_a_record_longer_than_blocks_and_all_places_kept(spark, tmp_path, blocks):
    long = "\n".join(f"line {k}, with \"quotes\"" for k in range(200))
    quoted = '"' + long.replace('"', '""') + '"'
    path = put(tmp_path, "a.csv", f"id;note\n1;x\n2;{quoted}\n3;{quoted}\n4;y\n")
    blocks(100)
    df = src.scan_csv(spark, path, placed=True)
    assert ordered(df) == [("1", "x"), ("2", long), ("3", long), ("4", "y")]
    numbered = number_arrival(df)
    assert sorted((r[ROW], r["id"]) for r in numbered.collect()) == [(0, "1"), (1, "2"), (2, "3"), (3, "4")]


def test_headers(spark, tmp_path):
    assert src.scan_csv(spark, put(tmp_path, "e.csv", ""), ",").count() == 0
    assert src.scan_csv(spark, put(tmp_path, "h.csv", "\n\nbin|size\n"), "").columns == ["bin", "size"]
    twice = src.scan_csv(spark, put(tmp_path, "t.csv", "x,,X\n1,2,3\n"), ",")
    assert twice.columns == ["x0", "_c1", "X2"] and twice.first() == ("1", "2", "3")
    bare = src.scan_csv(spark, put(tmp_path, "n.csv", '"p\nq"\tr\ns\tt\n'), "\t", has_header=False)
    assert bare.columns == ["col_1", "col_2"] and sorted(map(tuple, bare.collect())) == [("p\nq", "r"), ("s", "t")]
    named = src.scan_csv(spark, put(tmp_path, "c.csv", "x,y\n1,2\n"), ",", columns=["a", "b", "c"])
    assert [tuple(r) for r in named.collect()] == [("1", "2", "")]


def test_an_open_quote_is_an_error(spark, tmp_path, blocks):
    path = put(tmp_path, "a.csv", 'id,note\n1,x\n2,"never closed\n3,y\n' + "4,z\n" * 50)
    blocks(60)
    with pytest.raises(ValueError, match="never closed"):
        src.scan_csv(spark, path, ",")


def test_folders_become_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, zone string").write.partitionBy("zone").csv(str(tmp_path / "c"), header=True)
    assert sorted(map(tuple, src.scan_csv(spark, str(tmp_path / "c"), ",").collect())) == [("1", "a"), ("2", "b"), ("3", "b")]


def test_a_job_reads_records_with_line_breaks(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,note\n9,"two\nlines"\n8,one\n')
    cfg = job_config({"prompt": {"input_template": "{{ .note }}"}, "input": {"type": "csv", "path": path}})
    rows = number_input(read_input(spark, cfg), cfg)
    assert sorted((r[ROW], r["id"], r["note"]) for r in rows.collect()) == [(0, "9", "two\nlines"), (1, "8", "one")]
    cfg = job_config({"prompt": {"input_template": "{{ .note }}"}, "input": {"type": "csv", "path": path, "order_by": ["id"]}})
    assert sorted((r[ROW], r["id"]) for r in number_input(read_input(spark, cfg), cfg).collect()) == [(0, "8"), (1, "9")]


# --- JSON ---------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("piece", "inside", "want"),
    [
        ('{"a":1', False, (False, 0)), ('"a{', False, (True, 0)), ('x"', True, (False, -1)), (r'x\"', True, (True, 0)), (r'"\\"', False, (False, -1)), (r'"\\\"[', False, (True, 0)),
        ("]", False, (False, -2)), ('":{"k":[{"z":"', True, (True, 3)), ("", False, (False, -1)), ("", True, (True, 0)),
    ],
)
def test_what_a_piece_does(piece, inside, want):
    assert effect(piece, inside) == want


def value(rng, depth=0):
    draw = rng.random()
    if draw < 0.5 or depth > 2:
        return rng.choice([1, 2.5, True, None, "a}b", 'q"{[', "\\", 'x\\"}]', '{"a":1}', "é€", "}", "]"])
    if draw < 0.75:
        return {f"k{j}": value(rng, depth + 1) for j in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("size", [30, 170])
@pytest.mark.parametrize("kind", ["array", "inner", "object"])
def test_objects_whatever_the_blocks(spark, tmp_path, blocks, size, kind):
    rng = random.Random(f"{size}{kind}")
    data = [{"id": k, "text": rng.choice(["a}b", "}{", '"', "\\", ""]), "any": value(rng), "sub": {"z": rng.randint(0, 9)}} for k in range(30)]
    decoys = {"x}": [1, "]", {}], "other": {"rows": [{"id": -1}]}, "data": {"more": {"rows": [{"id": -2}]}, "rows": data, "z": ["}"]}, "rows": [{"id": -3}], "end": 1}
    whole = {"array": data, "inner": decoys, "object": data[0]}[kind]
    path = put(tmp_path, "a.json", json.dumps(whole, indent=rng.choice([None, 2]), ensure_ascii=False))
    blocks(size)
    df = src.scan_json(spark, path, "$.data.rows" if kind == "inner" else "", "any string, id long, text string, sub struct<z:long>" if kind != "inner" else None, placed=True)
    got = [(r["id"], r["text"], r["sub"]["z"]) for r in df.orderBy("_src", "_block", "_place").collect()]
    assert got == [(r["id"], r["text"], r["sub"]["z"]) for r in (data if kind != "object" else data[:1])]
    if size < 100 and kind != "object":
        assert df.select("_block").distinct().count() > 5


def test_what_lies_at_a_path(spark, tmp_path):
    path = put(tmp_path, "p.json", '{"plan":{"legs":[{"km":3},{"km":4.5,"by":"rail"}],"owner":{"desk":"B"},"tags":["x"]}}')
    assert sorted(map(tuple, src.scan_json(spark, path, "plan.legs").select("km", "by").collect())) == [(3.0, None), (4.5, "rail")]
    assert [tuple(r) for r in src.scan_json(spark, path, "$.plan/owner").collect()] == [("B",)]
    known = src.scan_json(spark, path, "plan.legs", "plan struct<legs:array<struct<km:string>>>")
    assert sorted(map(tuple, known.collect())) == [("3",), ("4.5",)]
    for wrong in ("plan.none", "plan.tags", "none"):
        with pytest.raises((PySparkException, ValueError)):
            src.scan_json(spark, path, wrong).collect()


@pytest.mark.parametrize("text", ['[1,{"a":1}]', '[{"a":1},"x"]', '[{"a":1}', '[[{"a":1}]]', '[{"a":1}]]', '{"a":', '[{"a":"}]', '[{"a":1} {"b":2}; {}]', "[{'a':1}]", '{"a":1', '{"a":"}'])
def test_broken_files_fail(spark, tmp_path, text):
    with pytest.raises((PySparkException, Py4JJavaError, ValueError)):
        src.scan_json(spark, put(tmp_path, "a.json", text)).collect()


def test_several_files_and_folders(spark, tmp_path):
    put(tmp_path, "a.json", ' [ {"n":1} , {"n":2} ] ')
    put(tmp_path, "b.json", '\n{"n":3,"late":{"x":[]}}')
    put(tmp_path, "c.json", "[]")
    assert sorted(r["n"] for r in src.scan_json(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_lines_get_their_type_in_one_pass(spark, tmp_path):
    lines = [{"at": k} for k in range(40)] + [{"at": 0.5, "late": "x"}, {"at": 7, "late": 3, "deep": {"list": [1, 2], "none": None}}, {"deep": {"list": [], "more": True}}]
    path = put(tmp_path, "a.jsonl", "\n\n".join(map(json.dumps, lines)) + "\n  \n")
    df = src.scan_jsonl(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"at": "double", "late": "string", "deep": "struct<list:array<bigint>,more:boolean,none:string>"}
    got = [r for r in df.collect() if r["late"] or r["deep"]]
    assert [(r["at"], r["late"], r["deep"] and r["deep"]["list"]) for r in got] == [(0.5, "x", None), (7.0, "3", [1, 2]), (None, None, [])]
    with pytest.raises((PySparkException, Py4JJavaError)):
        src.scan_jsonl(spark, put(tmp_path, "b.jsonl", '{"a":1}\n{"a":\n')).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        src.scan_jsonl(spark, put(tmp_path, "c.jsonl", "plain words\n"), "a string").collect()
    assert src.scan_jsonl(spark, put(tmp_path, "d.jsonl", "\n")).count() == 0


def test_the_source_of_lines_is_read_once(spark, tmp_path):
    """The type comes from the copy: the source may be gone by then."""
    path = tmp_path / "a.jsonl"
    path.write_text('{"a":1}\n{"b":"x"}\n')
    df = src.scan_jsonl(spark, str(path))
    path.unlink()
    assert sorted((r["a"] or 0, r["b"] or "") for r in df.collect()) == [(0, "x"), (1, "")]
