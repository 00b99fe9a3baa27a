"""Run registered queries beside their SQL in DuckDB and compare the rows.

usage: python tools/check_oracle.py [sf] [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time
from collections import Counter

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb

from quire.registry import oracles, queries
from quire.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def compare(columns_a, rows_a, columns_b, rows_b) -> str | None:
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(columns_a)} != {sorted(columns_b)}"
    order_a = sorted(range(len(columns_a)), key=lambda i: columns_a[i])
    order_b = sorted(range(len(columns_b)), key=lambda i: columns_b[i])
    left = Counter(tuple(normal(r[i]) for i in order_a) for r in rows_a)
    right = Counter(tuple(normal(r[i]) for i in order_b) for r in rows_b)
    if left == right:
        return None
    only_left, only_right = list((left - right))[:3], list((right - left))[:3]
    return f"rows {sum(left.values())} vs {sum(right.values())}; spark {only_left} sql {only_right}"


def type_note(df, relation) -> str:
    """Type classes that differ between the two results."""
    kinds = {"bigint": "int", "int": "int", "BIGINT": "int", "INTEGER": "int", "string": "str",
             "VARCHAR": "str", "double": "float", "DOUBLE": "float", "boolean": "bool",
             "BOOLEAN": "bool", "timestamp_ntz": "ts", "TIMESTAMP": "ts", "date": "date", "DATE": "date"}
    spark_types = {c: kinds.get(t, t) for c, t in df.dtypes}
    sql_types = {c: kinds.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    odd = [f"{c}:{t}/{sql_types.get(c)}" for c, t in spark_types.items() if t != sql_types.get(c)]
    return " ".join(odd)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = oracles()
    bad = []
    for name, run in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            begin = time.time()
            df = run(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - begin
            if name not in sql:
                print(f"{name}: rows={len(rows)} {took:.2f}s (no SQL)", flush=True)
                continue
            begin = time.time()
            relation = con.sql(sql[name])
            fetched = relation.fetchall()
            sql_took = time.time() - begin
            problem = compare(df.columns, rows, relation.columns, fetched)
            note = type_note(df, relation)
            if note:
                problem = (problem or "") + f" types {note}"
        except Exception as error:  # report and go on to the next query
            problem, rows, took, sql_took = f"{type(error).__name__}: {str(error)[:700]}", [], 0, 0
        if problem:
            bad.append(name)
        print(f"{name}: {'FAIL ' + problem if problem else 'ok'} rows={len(rows)} {took:.2f}s sql={sql_took:.2f}s", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
