"""Side-by-side check of a query against its SQL twin. Run as a script for a report:

    python tests/oracle.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return ("f", round(v, 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", str(v))
    if v is None:
        return ("n", "")
    if isinstance(v, (list, tuple, dict)):
        return ("x", repr(v))
    return ("s", v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_sec = time.time() - started
    if sql is None:
        return {"rows": len(got), "sec": spark_sec, "ok": None}
    started = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    duck_sec = time.time() - started
    problem = None
    if got_cols != want_cols:
        problem = f"columns {got_cols} != {want_cols}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
        extra, missing = set(got) - set(want), set(want) - set(got)
        problem += f"\n    spark only {list(extra)[:2]}\n    duck only  {list(missing)[:2]}"
    elif got != want:
        bad = [(g, x) for g, x in zip(got, want) if g != x]
        problem = f"{len(bad)} of {len(got)} rows differ\n    spark {bad[0][0]}\n    duck  {bad[0][1]}"
    return {"rows": len(got), "sec": spark_sec, "duck": duck_sec, "ok": problem is None, "problem": problem}


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, prefixes: list[str]) -> None:
    import __spark_entry__ as entry

    queries, twins = entry.queries(), entry.oracle_sql()
    spark, con = session(), duck(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, name, fn, twins.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"ok": False, "problem": f"{type(e).__name__}: {str(e)[:700]}", "rows": 0, "sec": 0}
        mark = {True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]]
        failed += r["ok"] is False
        print(f"{mark} {name} rows={r['rows']} spark={r['sec']:.2f}s duck={r.get('duck', 0):.2f}s", flush=True)
        if r["ok"] is False:
            print("   ", r["problem"], flush=True)
    print(f"{len(queries)} registered, {len(twins)} with a twin, {failed} failed")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
