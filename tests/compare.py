"""Runs registered queries against DuckDB and compares whole results."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, Decimal, float)):
        return f"{Decimal(str(value)).normalize():f}" if not isinstance(value, float) else f"{value:.9g}"
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir: str, name: str, run, sql: str) -> str | None:
    df = run(spark, sf_dir)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs_cursor = con.execute(sql)
    theirs = canonical([d[0] for d in theirs_cursor.description], theirs_cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return (f"{len(ours[1])} vs {len(theirs[1])} rows; only ours {sorted(a - b)[:3]}; "
                f"only theirs {sorted(b - a)[:3]}")
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from fiscalspark.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            if name in sqls:
                found = differences(spark, con, sf_dir, name, run, sqls[name])
            else:
                found = f"(no SQL) {run(spark, sf_dir).count()} rows"
        except Exception as exc:  # report and go on with the next query
            found = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if found is None else 'FAIL' if not found.startswith('(no') else '    '} "
              f"{name} {time.time() - started:.1f}s {found or ''}", flush=True)
