"""Compare registered queries with their SQL twins: ``python tests/oracle.py SF NAME...``"""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, name, build, sql):
    started = time.time()
    frame = build(spark, folder)
    got_columns, got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    seconds = time.time() - started
    if sql is None:
        return seconds, len(got), None, ""
    answer = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in answer.description], answer.fetchall())
    if got_columns != want_columns:
        return seconds, len(got), False, f"columns {got_columns} != {want_columns}"
    if got != want:
        extra, lost = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
        return seconds, len(got), False, f"{len(got)} rows, want {len(want)}\n   spark only {extra}\n   sql only   {lost}"
    return seconds, len(got), True, ""


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from ruleweave.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session(8, "ruleweave-oracle")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("ORACLE_TIME_ZONE", "UTC"))
    con = connect(folder)
    bad = 0
    for name, build in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            seconds, n, same, note = compare(spark, con, folder, name, build, oracle_sql().get(name))
        except Exception as error:  # report and go on with the next query
            seconds, n, same, note = 0, 0, False, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += same is False
        verdict = {True: "ok", False: "DIFF", None: "rows"}[same]
        print(f"{verdict:5} {name:28} {n:8} rows {seconds:6.1f}s {note}", flush=True)
    print("failed:", bad)
