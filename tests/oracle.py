"""Run queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(con, df, sql) -> str | None:
    """None when both sides agree, else what differs."""
    left_cols, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right_cols, right = _rows([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if left != right:
        a, b = left - right, right - left
        return f"rows {sum(left.values())} / {sum(right.values())}; only spark {list(a.items())[:2]}; only sql {list(b.items())[:2]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from conftest import make_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark, con, bad = make_session(), duck(folder), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            problem = compare(con, df, sql) if sql else f"(rows only: {df.count()})"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        if problem and not problem.startswith("(rows"):
            bad += 1
        print(f"{'ok ' if not problem else 'BAD' if not problem.startswith('(rows') else '-- '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
