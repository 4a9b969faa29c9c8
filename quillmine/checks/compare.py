"""Run registered queries against their oracles: ``python -m quillmine.checks.compare [names]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from quillmine.checks.inputs import TABLES

KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def oracle_rows(sql: str, folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rel = con.sql(sql)
    return list(rel.columns), [str(t) for t in rel.types], rel.fetchall()


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, folder: str) -> str:
    """'' when the rows agree, else what differs."""
    got = [tuple(r) for r in df.collect()]
    columns, types, want = oracle_rows(sql, folder)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    mine = {n: KIND.get(t, t) for n, t in df.dtypes}
    theirs = dict(zip(columns, types))
    odd = {n: (mine[n], theirs[n]) for n in mine if mine[n] != theirs[n]}
    if odd:
        return f"types {odd}"
    a, b = sorted_rows(df.columns, got), sorted_rows(columns, want)
    if a == b:
        return "" if a else "both empty"
    only_a, only_b = sorted(set(a) - set(b), key=repr)[:3], sorted(set(b) - set(a), key=repr)[:3]
    return f"rows {len(a)} vs {len(b)}\n   spark {only_a}\n   duck  {only_b}"


def main(names, folder="/root/testdata/sf0.01"):
    from quillmine.checks import all_checked
    from quillmine.session import local_session

    spark = local_session("quillmine-compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, item in all_checked().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = item.build(spark, folder)
            if item.oracle is None:
                note = "" if df.count() else "empty"
                label = "rows"
            else:
                note, label = compare(df, item.oracle, folder), "same"
        except Exception as exc:
            note, label = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        bad += bool(note)
        print(f"{'FAIL' if note else label:5} {name:26} {time.time() - start:6.1f}s {note[:1800]}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    args = sys.argv[1:]
    where = [a for a in args if a.startswith("/")]
    main([a for a in args if not a.startswith("/")], *(where[:1]))
