"""Compare registered Spark queries with their DuckDB twins.

``python tests/oracle.py [--sf 0.01] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return f"{type(v).__name__}:{v!r}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, fn, text):
    df = fn(spark, folder)
    got = df.collect()
    cols, mine = rows_of(df.columns, [tuple(r) for r in got])
    if text is None:
        return len(mine), None, "rows only"
    rel = con.sql(text)
    ocols, theirs = rows_of(list(rel.columns), rel.fetchall())
    if cols != ocols:
        return len(mine), len(theirs), f"columns {cols} vs {ocols}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return len(mine), len(theirs), (
            f"values differ: {len(a - b)} only spark, {len(b - a)} only duck\n   spark {sorted(a - b)[:2]}\n   duck  {sorted(b - a)[:2]}"
        )
    return len(mine), len(theirs), "ok"


def main(argv):
    from paperloom.queries import load
    from paperloom.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                               "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = load()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.lower().startswith(p.lower()) for p in argv):
            continue
        t = time.time()
        try:
            n, m, verdict = compare(spark, con, folder, fn, oracle.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            n, m, verdict = None, None, f"FAILED {type(exc).__name__}: {str(exc)[:1500]}"
        if verdict not in ("ok", "rows only"):
            bad += 1
        print(f"{name:34s} {n} {m} {time.time() - t:.1f}s {verdict}", flush=True)
    print("bad:", bad, "of", len(queries))


if __name__ == "__main__":
    main(sys.argv[1:])
