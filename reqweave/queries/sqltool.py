"""Read-only SQL over the given tables: every query is its own comparison."""

from reqweave.operators.tools import sql_answer as answer, sql_query
from reqweave.queries.registry import Tables, query

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()

STATEMENTS = {
    "sql_join": """SELECT n_name, r_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS cents
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name""",
    "sql_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sql_anti_join": "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)",
    "sql_outer_join": "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "sql_group": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) * 100 AS BIGINT) AS qty_cents,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) * 100 AS BIGINT) AS price_cents FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sql_cube": "SELECT event_type, user_id % 3 AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY CUBE (event_type, user_id % 3)",
    "sql_window_rank": """WITH ranked AS (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_custkey, o_orderkey, place FROM ranked WHERE place <= 3""",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_union_except": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "sql_subquery": "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)",
}


def register_views(t: Tables) -> None:
    for name in TABLES:
        t(name).createOrReplaceTempView(name)


def _register(name: str, statement: str) -> None:
    @query(name, statement)
    def run(t: Tables):
        register_views(t)
        return sql_query(t.spark, statement)


for _name, _statement in STATEMENTS.items():
    _register(_name, _statement)


@query(
    "sql_answer",
    """SELECT concat('[', string_agg(concat('{"n_name":"', n_name, '","orders":', n, '}'), ',' ORDER BY n_name), ']') AS answer
FROM (SELECT n_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)""",
)
def sql_answer(t):
    register_views(t)
    return answer(t.spark, "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name ORDER BY n_name")
