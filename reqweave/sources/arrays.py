"""Objects of big JSON files, one file cut over many tasks: the elements of an array, or the one object of a file.

Pieces end at closing braces, so a block may begin anywhere: in a string, or at any depth. A first pass reports per block,
for both states of its start, where it ends and how far the depth of brackets rises; prefixes over the blocks of a
file give every block its true state and depth. The second pass cuts out the objects that stand at the depth of the wanted array. An
object that runs over the edge of a block is put together from its parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqweave.sources.blocks import BLOCK, BOM, PLACE, SIZE, SOURCE, pieces, runs, with_report, with_state
from reqweave.storage import materialize

_REST = re.compile(r'(?:[^"\\]++|\\.|\\\Z)*+"', re.DOTALL)
_STRING = re.compile(r'"(?:[^"\\]++|\\.|\\\Z)*+("?)', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.|\\\Z)*+"?|[{\[\]]', re.DOTALL)
_GAP = re.compile(r"[\s,]*+")


def effect(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends inside a string, and the change of depth, its closing brace included."""
    if inside:
        rest = _REST.match(piece)
        if rest is None:
            return True, 0
        piece = piece[rest.end() :]
    if '"' in piece:
        open_at_end = False

        def gone(m: re.Match) -> str:
            nonlocal open_at_end
            open_at_end = not m[1]
            return ""

        piece = _STRING.sub(gone, piece)
        inside = open_at_end
    else:
        inside = False
    depth = piece.count("{") + piece.count("[") - piece.count("]")
    return inside, depth if inside else depth - 1


KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _fields(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (f.split() for f in ddl.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


REPORT = f"{SOURCE} string, {BLOCK} long, out boolean, inside boolean, rise_out long, rise_inside long, head string, bytes long, size long"


def block_reports(placed: DataFrame) -> DataFrame:
    """Per block: state at its end and change of depth for both states at its start, its first character and bytes; the file's size."""
    schema = _fields(REPORT)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, size = None, (), 0
        for here, rows in runs(batches):
            if here != key:
                if key is not None:
                    yield _batch([(*key, *state, size)], schema)
                key, state, size = here, (False, True, 0, 0, "", 0), rows.column(3)[0].as_py()
            read = state[5] + rows.num_rows + (pc.sum(pc.binary_length(rows.column(2))).as_py() or 0)
            for piece in rows.column(2).to_pylist():
                out, rise = effect(piece, state[0])
                inside, other = (out, rise) if state[0] == state[1] else effect(piece, state[1])
                first = state[4] or (piece + "}").lstrip(BOM + " \t\r\n")[:1]
                state = out, inside, state[2] + rise, state[3] + other, first, read
        if key is not None:
            yield _batch([(*key, *state, size)], schema)

    return placed.select(SOURCE, BLOCK, "value", SIZE).mapInArrow(report, REPORT)


BRACKET = f"{SOURCE} string, {BLOCK} long, {PLACE} long, at long, depth long, name string, array boolean, opens boolean"


def shallow_brackets(told: DataFrame, most: int) -> DataFrame:
    """Brackets that open or close a depth of at most ``most``, with the member name before an opening one."""
    schema = _fields(BRACKET)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, out = None, False, 0, []
        for here, rows in runs(batches):
            if here != key:
                key, inside, depth = here, rows.column(4)[0].as_py(), rows.column(5)[0].as_py()
            for place, piece in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if depth > most + 1 and "]" not in piece:
                    inside, rise = effect(piece, inside)
                    depth += rise
                    continue
                start, name = 0, None
                if inside:
                    rest = _REST.match(piece)
                    if rest is None:
                        continue
                    start, inside = rest.end(), False
                for token in _TOKEN.finditer(piece, start):
                    kind = token[0][0]
                    if kind == '"':
                        inside, name = not _STRING.match(token[0])[1], token
                    elif kind == "]":
                        if depth <= most:
                            out.append((*key, place, token.start(), depth, None, True, False))
                        depth -= 1
                    else:
                        depth += 1
                        if depth <= most:
                            named = name is not None and piece[name.end() : token.start()].strip() == ":"
                            out.append((*key, place, token.start(), depth, json.loads(name[0]) if named else None, kind == "[", True))
                if not inside:
                    if depth <= most:
                        out.append((*key, place, len(piece), depth, None, False, False))
                    depth -= 1
            if len(out) > 10_000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    return told.select(SOURCE, BLOCK, PLACE, "value", "begins_inside", "depth").mapInArrow(find, BRACKET)


def array_ranges(brackets: DataFrame, steps: list[str]) -> DataFrame:
    """``_src, from_, to_``: where the array at ``steps`` opens and closes in each file, as (block, place, offset)."""
    order = Window.partitionBy(SOURCE).orderBy(BLOCK, PLACE, "at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth, spot = len(steps) + 1, F.struct(BLOCK, PLACE, "at")
    named = F.col("opens") & F.col("array") & (F.col("depth") == depth)
    for k, step in enumerate(steps):  # the member that opened each depth last
        named &= F.coalesce(F.last(F.when(F.col("opens") & (F.col("depth") == k + 2), F.coalesce(F.col("name") == step, F.lit(False))), ignorenulls=True).over(upto), F.lit(False))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    close = F.first(F.when(~F.col("opens") & (F.col("depth") == depth), spot), ignorenulls=True).over(after)
    return brackets.withColumn("_named", named).withColumn("to_", close).where("_named").select(SOURCE, spot.alias("from_"), "to_")


ELEMENT = f"{SOURCE} string, {BLOCK} long, {PLACE} long, value string, chain boolean, ends boolean"
EVERYWHERE = "CAST(NULL AS struct<b:long,p:long,a:long>)"


def _cut(told: DataFrame) -> DataFrame:
    """Objects that open at depth ``base`` inside the range of their file, and the parts of those that run over a block's edges.

    Anything else between the elements of an array is an error.
    """
    schema = _fields(ELEMENT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, base, low, high = None, False, 0, 0, None, None
        active, held, whole, place, out = False, [], True, 0, []

        def gap(text: str) -> None:
            if _GAP.fullmatch(text) is None:
                raise ValueError(f"{key[0]} holds something else than objects: {text.strip()[:60]}")

        for here, rows in runs(batches):
            if here != key:
                if active:
                    out.append((*key, place, "".join(held), True, False))
                if rows.column(4)[0].as_py() is None:
                    raise RuntimeError("the blocks of the input have changed between two reads; keep the number of executors or set spark.sql.files.minPartitionNum")
                key, inside, depth, base, low, high = here, *(rows.column(k)[0].as_py() for k in range(4, 9))
                low, high = (tuple(x.values()) if x else None for x in (low, high))
                place, held = rows.column(2)[0].as_py(), []
                active = depth > base and (low is None or low < (key[1], place, 0)) and (high is None or (key[1], place, 0) < high)
                whole = not active
            for at, piece in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                spot = lambda offset: (key[1], at, offset)  # noqa: E731, B023
                if (low is not None and spot(len(piece)) < low) or (high is not None and spot(0) > high):
                    inside, rise = effect(piece, inside)
                    depth += rise
                    continue
                since = 0 if active or depth == base else None  # begin of the running element's text, or of the gap before the next one
                start = 0
                if inside:
                    rest = _REST.match(piece)
                    start, inside = (len(piece), True) if rest is None else (rest.end(), False)
                for token in () if inside else _TOKEN.finditer(piece, start):
                    kind, begin = token[0][0], token.start()
                    if kind == '"':
                        inside = not _STRING.match(token[0])[1]
                    elif kind == "]":
                        if depth == base and not active and since is not None:
                            gap(piece[since:begin])
                            since = None
                        depth -= 1
                    else:
                        if depth == base and not active and since is not None:
                            gap(piece[since:begin].lstrip(BOM))
                            if kind == "[" and (base or not low):
                                raise ValueError(f"{key[0]} holds arrays where objects are wanted")
                            active, held, whole, since, place = True, [], True, begin, at
                        depth += 1
                        if depth == base and kind == "[" and (low is None or spot(begin) == low):
                            since = token.end()
                if not inside:
                    depth -= 1
                if active:
                    held.append(piece[since:] + "}")
                    if not inside and depth == base:
                        out.append((*key, place, "".join(held), not whole, True))
                        active, held = False, []
            if len(out) > 1_000:
                yield _batch(out, schema)
                out = []
        if active:
            out.append((*key, place, "".join(held), True, False))
        yield _batch(out, schema)

    return told.select(SOURCE, BLOCK, PLACE, "value", "begins_inside", "depth", "base", "from_", "to_").mapInArrow(cut, ELEMENT)


def json_objects(spark: SparkSession, path: str, steps: list[str]) -> tuple[DataFrame, bool]:
    """``_src, _block, _place, value``: the objects of all files as JSON texts, and whether ``steps`` have been followed.

    A file is an array of objects, an object, or holds an array of objects at ``steps``. Where no file has an array
    there, the objects come whole and ``steps`` are left to the caller.
    """
    placed = pieces(spark, path, "}")
    order = Window.partitionBy(SOURCE).orderBy(BLOCK)
    rise = F.when(F.col("begins_inside"), F.col("rise_inside")).otherwise(F.col("rise_out"))
    reports = with_state(block_reports(placed)).withColumn("rise", rise)
    depth = F.coalesce(F.sum("rise").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    reports = materialize(reports.select(SOURCE, BLOCK, "begins_inside", "rise", depth.alias("depth"), first.alias("head"), "bytes", "size"), "json-blocks")
    # a last piece without a brace behind it was counted as if it had one: it is one byte and one step of depth too many
    ended = reports.groupBy(SOURCE).agg(F.sum("rise").alias("rise"), (F.sum("bytes") - F.max("size")).alias("more"))
    bad = ended.where("rise <> -more").select(SOURCE).first()
    if bad:
        raise ValueError(f"{bad[0]} does not end where its value ends")
    blocks = reports.select(SOURCE, BLOCK, "begins_inside", "depth", F.when(F.col("head") == "[", 1).otherwise(0).alias("base"))
    nested = bool(steps) and not reports.where("head = '{'").isEmpty()
    ranges = None
    if nested:
        told = with_report(placed, blocks)
        ranges = materialize(array_ranges(shallow_brackets(told, len(steps) + 1), steps), "json-ranges")
        found, files, distinct = ranges.count(), reports.select(SOURCE).distinct().count(), ranges.select(SOURCE).distinct().count()
        if found and (found != distinct or distinct != files):
            raise ValueError(f"not every file has one array at {'.'.join(steps)}")
        nested = found > 0
    if nested:
        blocks = blocks.drop("base").join(ranges, SOURCE).withColumn("base", F.lit(len(steps) + 1))
    else:
        blocks = blocks.withColumns({"from_": F.expr(EVERYWHERE), "to_": F.expr(EVERYWHERE)})
    found = materialize(_cut(with_report(placed, blocks.select(SOURCE, BLOCK, "begins_inside", "depth", "base", "from_", "to_"))), "json-objects")
    # parts follow each other; those up to the one that ends an element belong to it
    before = Window.partitionBy(SOURCE).orderBy(BLOCK, PLACE).rowsBetween(Window.unboundedPreceding, -1)
    parts = found.where("chain").withColumn("number", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), F.lit(0)))
    joined = parts.groupBy(SOURCE, "number").agg(F.array_sort(F.collect_list(F.struct(BLOCK, PLACE, "value"))).alias("p"))
    opening = F.get("p", F.lit(0))
    whole = joined.select(SOURCE, opening[BLOCK].alias(BLOCK), opening[PLACE].alias(PLACE), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    return found.where("NOT chain").select(SOURCE, BLOCK, PLACE, "value").unionByName(whole), nested


def columns_of(texts: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The members of JSON objects (``value``) as columns behind the other columns of ``texts``; a bad text fails the read.

    Without a schema the texts are written once and their common type is taken from that copy, late members included:
    members of several types are text, numbers with a fraction doubles. The source is not read again.
    """
    if schema is None:
        texts = materialize(texts, "json-texts")
        schema = common_type(texts)
    if not schema.fields:
        return texts.drop("value")
    parsed = texts.withColumn("_object", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return parsed.select(*[c for c in texts.columns if c != "value"], "_object.*")


def common_type(texts: DataFrame) -> T.StructType:
    """Type that holds the objects of all texts."""
    found = texts.select(F.schema_of_variant_agg(F.parse_json("value")).alias("t")).first()["t"]
    if not found or not found.startswith("OBJECT<"):
        if found in (None, "VOID"):
            return T.StructType([])
        raise ValueError(f"records are no objects: {found}")
    ddl = re.sub(r"\bOBJECT<>", "MAP<STRING, STRING>", found)
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", ddl)
    ddl = re.sub(r"(?<=[ <])DECIMAL\(\d+, ?0\)", "DECIMAL(38,0)", ddl)
    ddl = re.sub(r"(?<=[ <])DECIMAL\(\d+, ?[1-9]\d*\)", "DOUBLE", ddl)
    ddl = re.sub(r"(?<=[ <])(VOID|VARIANT)\b", "STRING", ddl)
    return T.StructType.fromDDL(f"r {ddl}").fields[0].dataType
