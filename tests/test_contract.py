"""The driver contract, checked before any session exists."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_load_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, checked = map(int, done.stdout.split())
    assert queries > 100 and checked > 90


def test_every_inventory_id_has_a_query():
    from pleonasm.catalog import load

    covered = {c for item in load().values() for c in item.covers}
    expected = {f"A{i}" for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)} | {f"B{i}" for i in range(1, 15)}
    expected |= {f"C{i}" for i in range(1, 30)} - {"C3"}
    expected |= {f"D{i}" for i in range(1, 16)} | {f"E{i}" for i in range(1, 24)}
    expected |= {f"F{i}" for i in range(1, 31)} - {"F21"}
    expected |= {f"G{i}" for i in range(1, 14)} | {f"H{i}" for i in range(1, 6)} | {f"I{i}" for i in range(1, 6)}
    expected |= {"S1", "S2", "S3", "S4", "S6", "U4"} | {f"J{i}" for i in range(1, 11)}
    assert expected - covered == set()


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
