"""Runs registered queries against their SQL and prints what differs.

    python tests/check_queries.py [scale folder] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(_plain(r[k]) for k in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def _plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    return v


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short account of the difference."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs_columns, theirs = rows_of(names, cursor.fetchall())
    columns, ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if columns != theirs_columns:
        return f"columns {columns} vs {theirs_columns}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {columns}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = args or list(queries)
    names = [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    failed = 0
    for name in names:
        started = time.time()
        try:
            if name in oracles:
                con.execute("EXPLAIN " + oracles[name])
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - started
        failed += problem is not None
        note = "" if name in oracles else " (no SQL)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.2f}s{note}" + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
