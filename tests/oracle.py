"""Runs registered queries on both engines and compares the rows.

    python tests/oracle.py [folder] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_side(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def check_side(con, sql):
    result = con.sql(sql)
    return table(result.columns, result.fetchall())


def compare(spark, con, folder, item):
    """None when equal, otherwise what differs."""
    left_columns, left = spark_side(item.build(spark, folder))
    if item.sql is None:
        return None if left else "no rows"
    right_columns, right = check_side(con, item.sql)
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return f"rows {len(left)} / {len(right)}\n   spark: {only_left}\n   check: {only_right}"
    return None if left else "both empty"


if __name__ == "__main__":
    from pleonasm.catalog import load
    from pleonasm.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark, con = local_session(cpus=int(os.environ.get("ORACLE_CPUS", 8))), connect(folder)
    bad = 0
    for name, item in load().items():
        if parts and not any(p in name or p in item.covers or p == item.module for p in parts):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, folder, item)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error).split(chr(10)+chr(9)+'at ')[0][:500]}"
        bad += problem is not None
        kind = "rows" if item.sql is None else "sql"
        print(f"{'ok  ' if problem is None else 'BAD '} {name} [{','.join(item.covers)}] {kind} {time.time() - started:.1f}s" + (f"  {problem}" if problem else ""), flush=True)
    print("bad:", bad)
