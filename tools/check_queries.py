"""Compare registered queries with their SQL on a table folder.

Usage: python tools/check_queries.py FOLDER [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from storyloom.plans.catalog import REGISTRY  # noqa: E402
from storyloom.session import build_session  # noqa: E402


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    q = REGISTRY[name]
    start = time.time()
    df = q.run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if not q.sql:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    res = con.execute(q.sql)
    columns, want = [c[0] for c in res.description], res.fetchall()
    sql_spent = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {df.columns} against {columns}"
    a, b = normal(got, df.columns), normal(want, columns)
    if a == b:
        return True, f"{len(got)} rows, {spent:.1f}s, SQL {sql_spent:.1f}s"
    only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    short = lambda rows: [tuple(v[:300] for v in r) for r in rows]
    return False, f"{len(got)} against {len(want)} rows\n   spark {short(only_a)}\n   sql   {short(only_b)}"


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception:
            ok, note = False, traceback.format_exc()[-1500:]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; differing: {bad}")


if __name__ == "__main__":
    main()
