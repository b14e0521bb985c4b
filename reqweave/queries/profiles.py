"""Column profiles and listings."""

from pyspark.sql import functions as F

from reqweave.functions.jsonvals import framed, framed_value
from reqweave.operators import history, profile as ops
from reqweave.operators.ordering import ROW
from reqweave.queries.derived import VALUE
from reqweave.queries.registry import Tables, query


def _examples(table: str, key: str, text: str, where: str) -> str:
    return (
        f"(SELECT coalesce(string_agg(v, '|' ORDER BY k), '') FROM (SELECT {text} AS v, min({key}) AS k FROM {table} WHERE {where} GROUP BY 1 ORDER BY 2 LIMIT 3))"
    )


def _column(table: str, key: str, name: str, kind: str, text: str | None = None, where: str = "true") -> str:
    shown = text or f"CAST({name} AS string)"
    return (
        f"SELECT '{name}' AS column_name, '{kind}' AS type, (SELECT count(*) FROM {table} WHERE NOT ({where})) AS n_empty, "
        f"{_examples(table, key, shown, where)} AS examples"
    )


def _shown(profile):
    return profile.select(
        F.col("column").alias("column_name"), "type", F.col("empty").alias("n_empty"), F.array_join("examples", "|").alias("examples")
    )


_BLANK = "(SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_mktsegment END AS segment, c_nationkey > 12 AS far, CAST(NULL AS string) AS nothing FROM customer)"
_NUM = "regexp_replace(CAST({} AS string), '\\.0$', '')"


@query(
    "column_profile",
    " UNION ALL ".join([
        _column(_BLANK, "c_custkey", "c_custkey", "number"),
        _column(_BLANK, "c_custkey", "c_name", "string"),
        _column(_BLANK, "c_custkey", "c_acctbal", "number", _NUM.format("c_acctbal")),
        _column(_BLANK, "c_custkey", "segment", "string", where="segment IS NOT NULL AND trim(segment) <> ''"),
        _column(_BLANK, "c_custkey", "far", "bool"),
        _column(_BLANK, "c_custkey", "nothing", "empty", where="nothing IS NOT NULL"),
    ]),
)
def column_profile(t):
    k = F.col("c_custkey") % 3
    df = t("customer").select(
        F.col("c_custkey").alias(ROW), "c_custkey", "c_name", "c_acctbal", F.when(k == 0, " ").when(k == 2, F.col("c_mktsegment")).alias("segment"),
        (F.col("c_nationkey") > 12).alias("far"), F.lit(None).cast("string").alias("nothing"),
    )
    return _shown(ops.column_profile(df))


_EVENTS = "(SELECT event_id, event_type, user_id, value, props FROM events)"


@query(
    "first_examples",
    " UNION ALL ".join([
        _column(_EVENTS, "event_id", "event_type", "string"), _column(_EVENTS, "event_id", "user_id", "number"),
        _column(_EVENTS, "event_id", "value", "number", _NUM.format("value")), _column(_EVENTS, "event_id", "props", "string"),
    ]),
)
def first_examples(t):
    df = t("events").withColumn(ROW, F.col("event_id"))
    return _shown(ops.column_profile(df, ["event_type", "user_id", "value", "props"]))


_MIXED = """CASE event_id % 7 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN CAST(user_id AS string) WHEN 2 THEN event_type
  WHEN 3 THEN concat('[', user_id, ',"', event_type, '"]') ELSE '1' END"""


@query(
    "column_profile_mixed",
    f"""SELECT 'value' AS column_name, 'number' AS type, (SELECT count(*) FROM events WHERE event_id % 7 IN (5, 6)) AS n_empty,
  (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT {_MIXED} AS v, min(event_id) AS k FROM events WHERE event_id % 7 < 5 GROUP BY 1 ORDER BY 2 LIMIT 6)) AS examples""",
)
def column_profile_mixed(t):
    # values of every kind in one VARIANT column, blank texts among them; numbers are as frequent as any other kind or more
    k = F.col("event_id") % 7
    number = F.when(k == 4, F.lit("1")).when(k == 6, F.lit('" \\t "')).otherwise(F.expr(VALUE))
    df = t("events").select(F.col("event_id").alias(ROW), framed_value(framed(number)).alias("value"))
    return _shown(ops.column_profile(df, examples=6))


@query(
    "dominant_type",
    """SELECT user_id, CASE WHEN n + s + b = 0 THEN 'empty' WHEN b >= n AND b >= s THEN 'bool' WHEN n >= s THEN 'number' ELSE 'string' END AS type
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n, count(*) FILTER (WHERE event_type = 'click') AS s, count(*) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY 1)""",
)
def dominant_type(t):
    kinds = {"number": "view", "string": "click", "bool": "error"}
    counts = t("events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(k) for k, e in kinds.items()])
    return counts.select("user_id", ops.dominant_type({k: F.col(k) for k in kinds}).alias("type"))


@query(
    "run_history",
    "SELECT run_id, status FROM (SELECT o_orderkey AS run_id, o_orderstatus AS status FROM orders ORDER BY 1 DESC LIMIT 5000) WHERE run_id % 3 <> 0",
)
def run_history(t):
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("archived"))
    return history.run_history(runs, 5000).select("run_id", "status")


def _presets(t: Tables):
    k = F.col("p_partkey")
    return t("part").select(
        k.alias("pos"), F.concat(F.lit(" "), F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"), F.lit(" ")).alias("id"),
        F.when(k % 2 == 0, F.col("p_name")).otherwise(" ").alias("label"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("provider"),
        F.col("p_name").alias("model"),
    )


@query(
    "clean_reference_table",
    """SELECT p_partkey AS pos, concat(p_brand, '-', p_size) AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat(p_brand, '-', p_size) END AS label, lower(p_type) AS provider, p_name AS model
FROM part WHERE p_partkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1""",
)
def clean_reference_table(t):
    return history.clean_reference_table(_presets(t), "pos")
