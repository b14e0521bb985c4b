"""Row numbers, projections, batches and cells."""

# The prompt and error texts inside the comparison SQL are those that generators are asked with.

from pyspark.sql import functions as F

from reqweave.operators import batches as bat
from reqweave.operators import merge, ordering as ops
from reqweave.operators.ordering import ROW
from reqweave.operators.spec import one_job, spec_frame
from reqweave.queries.registry import Tables, query

_NUMBERED = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders"


def numbered_orders(t: Tables):
    return ops.row_index(t("orders"), ["o_orderkey"])


@query("row_index", f"SELECT o_orderkey, row_idx FROM ({_NUMBERED})")
def row_index(t):
    return numbered_orders(t).select("o_orderkey", F.col(ROW).alias("row_idx"))


@query("row_index_with_ties", "SELECT l_shipdate, count(*) AS n, min(row_idx) AS first_idx, max(row_idx) AS last_idx FROM (SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) - 1 AS row_idx FROM lineitem) GROUP BY 1")
def row_index_with_ties(t):
    numbered = ops.row_index(t("lineitem").select("l_shipdate"), ["l_shipdate"])
    return numbered.groupBy("l_shipdate").agg(F.count("*").alias("n"), F.min(ROW).alias("first_idx"), F.max(ROW).alias("last_idx"))


@query("number_in_group", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS group_idx FROM events")
def number_in_group(t):
    numbered = ops.number_in_group(t("events").select("event_id", "event_type"), "event_type", ["event_id"])
    return numbered.select("event_id", F.col("_group_idx").alias("group_idx"))


@query("ordered_emit", f"SELECT row_idx, o_orderkey, o_custkey FROM ({_NUMBERED})")
def ordered_emit(t):
    return ops.ordered_emit(numbered_orders(t)).select(F.col(ROW).alias("row_idx"), "o_orderkey", "o_custkey")


@query("preview_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500")
def preview_limit(t):
    return ops.preview_limit(t("orders"), 500, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("latest_results", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def latest_results(t):
    return ops.latest_results(t("orders"), name="o_orderkey").select("o_orderkey", "o_orderstatus")


@query("exclude_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def exclude_columns(t):
    return ops.exclude_columns(t("customer"), ["c_name", "c_acctbal", "c_unknown"])


_BLANKED = ["CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END", "CASE WHEN c_custkey % 4 = 0 THEN cast(null as string) WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END"]


@query("skip_blank_rows", f"SELECT {_BLANKED[0]} AS a, {_BLANKED[1]} AS b FROM customer WHERE c_custkey % 3 <> 0")
def skip_blank_rows(t):
    return ops.skip_blank_rows(t("customer").select(F.expr(_BLANKED[0]).alias("a"), F.expr(_BLANKED[1]).alias("b")))


@query("carry_input", "SELECT c_custkey, 1 AS score FROM customer")
def carry_input(t):
    df = t("customer").withColumn("score", F.lit(1))
    return df.select(*merge.carry_input(t("customer").columns, True, "c_custkey"), "score")


@query("output_fields", "SELECT c_name, c_custkey FROM customer")
def output_fields(t):
    return merge.output_fields(t("customer"), ["c_name", "missing", "c_custkey"])


@query(
    "union_columns",
    """SELECT CAST(NULL AS DOUBLE) AS balance, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_acctbal, s_suppkey, s_name, NULL FROM supplier""",
)
def union_columns(t):
    customers = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return merge.union_columns([customers, suppliers])


@query(
    "stringify_cell",
    """SELECT CAST(p_partkey AS string) AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS name, regexp_replace(CAST(p_retailprice AS string), '\\.0$', '') AS price,
  CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS big, concat('{"brand":"', p_brand, '","sizes":[', p_size, ',', p_size + 1, ']}') AS detail FROM part""",
)
def stringify_cell(t):
    df = t("part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") > 20).alias("big"), F.struct(F.col("p_brand").alias("brand"), F.array("p_size", F.col("p_size") + 1).alias("sizes")).alias("detail"),
    )
    return merge.stringify(df)


# --- batches of 16 orders ------------------------------------------------------
SIZE = 16
_PAYLOAD = "concat('{', chr(10), '  \"key\": ', cast(o_orderkey as string), ',', chr(10), '  \"status\": \"', o_orderstatus, '\"', chr(10), '}')"
_SPEC = {"level": "int", "status": "string"}


def _batches(t: Tables):
    from reqweave.functions.jsonvals import pretty_record

    rows = numbered_orders(t).select(ROW, F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return bat.make_batches(rows.withColumn("body", pretty_record(rows, ["key", "status"])), SIZE)


@query(
    "make_batches",
    f"SELECT row_idx // {SIZE} AS batch_id, count(*) AS n, string_agg(CAST(o_orderkey AS string), ',' ORDER BY row_idx) AS keys FROM ({_NUMBERED}) GROUP BY 1",
)
def make_batches(t):
    made = bat.make_batches(numbered_orders(t).select(ROW, "o_orderkey"), SIZE)
    return made.select("batch_id", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("keys"))


@query(
    "batch_prompt",
    f"""SELECT row_idx // {SIZE} AS batch_id, concat('Process the following ', count(*), ' records. Return ONLY a valid JSON array containing exactly ', count(*), ' JSON objects, one per record, in the same order.', chr(10),
  'Each object must contain exactly these fields:', chr(10), '- level: int', chr(10), '- status: string', chr(10), chr(10),
  '[', chr(10), string_agg(concat('  ', replace({_PAYLOAD}, chr(10), chr(10) || '  ')), ',' || chr(10) ORDER BY row_idx), chr(10), ']', chr(10), chr(10), 'Be quick.') AS prompt
FROM ({_NUMBERED}) GROUP BY 1""",
)
def batch_prompt(t):
    job = one_job(spec_frame(t.spark, _SPEC))
    text = bat.batch_user_text(F.col("rows"), "body", job.text("batch_lines"), F.lit(False), "Be quick.")
    return _batches(t).select("batch_id", text.alias("prompt"))


def _answered(t: Tables):
    """Batch answers: good ones, a missing item, a bad item, prose, an object."""
    item = lambda r: F.concat(F.lit('{"status":"'), r["status"], F.lit('","level":'), r["key"].cast("string"), F.lit("}"))
    items = F.array_join(F.transform("rows", item), ", ")
    fewer = F.array_join(F.transform(F.slice("rows", F.lit(1), F.size("rows") - 1), item), ", ")
    k = F.col("batch_id") % 5
    text = (
        F.when(k == 1, F.concat(F.lit("["), fewer, F.lit("]")))
        .when(k == 2, F.concat(F.lit('["only words", '), fewer, F.lit("]")))
        .when(k == 3, F.concat(F.lit("Here: ["), items, F.lit("] end")))
        .when(k == 4, "no list at all")
        .otherwise(F.concat(F.lit("["), items, F.lit("]")))
    )
    return _batches(t).withColumn("response", text)


_ITEM = "concat('{\"status\":\"', o_orderstatus, '\",\"level\":', o_orderkey, '}')"
_BATCHED = f"SELECT *, row_idx // {SIZE} AS b, row_idx % {SIZE} AS pos, count(*) OVER (PARTITION BY row_idx // {SIZE}) AS n FROM ({_NUMBERED})"
_BATCH_ERROR = """CASE b % 5 WHEN 1 THEN concat('batch response length mismatch: expected ', n, ' objects, got ', n - 1)
  WHEN 2 THEN 'batch response item 0: invalid JSON object' WHEN 3 THEN 'invalid JSON array' WHEN 4 THEN 'invalid JSON array' END"""


@query(
    "split_batch_strict",
    f"SELECT o_orderkey AS key, CASE WHEN b % 5 = 0 THEN {_ITEM} END AS item, CASE WHEN b % 5 = 0 THEN o_orderkey END AS level, {_BATCH_ERROR} AS error FROM ({_BATCHED})",
)
def split_batch_strict(t):
    split = bat.split_batch_strict(_answered(t), one_job(spec_frame(t.spark, _SPEC)))
    return split.select("key", "item", F.try_variant_get(F.element_at("parsed", F.lit("level")), "$", "bigint").alias("level"), "error")


@query(
    "split_batch_lenient",
    f"""SELECT o_orderkey AS key, CASE b % 5 WHEN 4 THEN 'no list at all' WHEN 1 THEN CASE WHEN pos = n - 1 THEN '' ELSE {_ITEM} END
  WHEN 2 THEN CASE WHEN pos = 0 THEN 'only words' ELSE lag({_ITEM}) OVER (PARTITION BY b ORDER BY pos) END ELSE {_ITEM} END AS item FROM ({_BATCHED})""",
)
def split_batch_lenient(t):
    return bat.split_batch_lenient(_answered(t)).select("key", "item")


@query(
    "batch_failure_rows",
    f"SELECT o_orderkey AS key, CASE WHEN b % 5 = 0 THEN {_ITEM} ELSE '' END AS response, b % 5 <> 0 AS failed FROM ({_BATCHED})",
)
def batch_failure_rows(t):
    kept = bat.keep_failed_rows(bat.split_batch_strict(_answered(t), one_job(spec_frame(t.spark, _SPEC))))
    return kept.select("key", "response", F.col("error").isNotNull().alias("failed"))
