"""Run every registered query beside its SQL and compare the rows.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.  Floats must be equal in
their printed form; set ``DIGITS`` to compare fewer digits.
"""

from __future__ import annotations

import decimal
import math
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

DIGITS = int(os.environ.get("DIGITS", "17"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.{DIGITS}g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {got_cols} / {want_cols}", len(got)
    if got != want:
        got_set, want_set = set(got), set(want)
        extra = [r for r in got if r not in want_set][:3]
        missing = [r for r in want if r not in got_set][:3]
        return f"rows differ: {len(got)} / {len(want)}\n   spark {extra}\n   sql   {missing}", len(got)
    return None, len(got)


def main(argv):
    import __spark_entry__ as entry
    from tracemill.session import local_session

    sf_dir = argv[0]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        begun = time.time()
        try:
            if name in oracle:
                problem, n = compare(spark, con, queries[name], oracle[name], sf_dir)
            else:
                problem, n = None, queries[name](spark, sf_dir).count()
        except Exception as error:  # report and go on
            problem, n = f"failed: {str(error)[:1500]}", 0
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "sql" if name in oracle else "rows"
        print(f"{mark} {kind:4} {name:28} {n:8} rows {time.time() - begun:6.2f}s {problem or ''}", flush=True)
    print("bad:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
