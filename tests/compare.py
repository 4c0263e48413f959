"""Compare registered queries with their oracle SQL on the driver's tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(_value(r[i]) for i in order) for r in rows]
    return sorted(found, key=repr)


def compare(spark, con, query, sql, folder) -> str:
    """Empty text when both agree, else what differs."""
    df = query(spark, folder)
    mine = _bag(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _bag(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:3]
        only_theirs = [r for r in theirs if r not in set(mine)][:3]
        return f"rows {len(mine)} vs {len(theirs)}; {sorted(names)} only spark {only_mine}; only oracle {only_theirs}"
    kinds = {type(a) for r in mine for a in r} ^ {type(a) for r in theirs for a in r}
    return f"types {kinds}" if kinds else ""


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from asofmill.session import build_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if chosen and not any(name == x or (x.endswith("*") and name.startswith(x[:-1])) for x in chosen):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, query, oracles[name], folder) or "ok"
            else:
                result = f"ok (rows only: {query(spark, folder).count()})"
        except Exception as error:  # noqa: BLE001
            result = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        bad += not result.startswith("ok")
        print(f"{name:34s} {time.time() - start:6.2f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
