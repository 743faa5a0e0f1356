"""Batches merged into a table, against a dictionary that takes the same rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pleonasm.sources.keyed import KeyedTable

SCHEMA = "k int, ts int, value string, n long, born int"


def batch(rng, keys, size):
    return [(rng.choice(keys), rng.randrange(10**6), f"v{rng.randrange(99)}", rng.randrange(5), rng.randrange(1000)) for _ in range(size)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/table") for f in fs if f.startswith("part-")}


@pytest.fixture()
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", "k", ["ts"], added=("n",), first=("born",), parts=16)


def expected(batches):
    out = {}
    for rows in batches:
        for k, ts, v, n, born in rows:
            old = out.get(k)
            out[k] = (ts, v, n, born) if old is None else (max(ts, old[0]), v if ts > old[0] else old[1], n + old[2], min(born, old[3]))
    return out


def held(table):
    return {r.k: (r.ts, r.value, r.n, r.born) for r in table.read().collect()}


def test_batches_against_a_dictionary(spark, table, tmp_path):
    rng = random.Random(4)
    keys = [None, *range(40)]
    batches = [batch(rng, keys, 200), batch(rng, [3], 300) + batch(rng, [7, 90], 40), batch(rng, keys[:4], 30)]
    for number, rows in enumerate(batches):
        before = files(tmp_path / "t") if number else {}
        table.merge(spark.createDataFrame(rows, SCHEMA).repartition(3), number)
        assert held(table) == expected(batches[: number + 1])
        if number:
            parts = {r.p for r in spark.createDataFrame(rows, SCHEMA).select(F.pmod(F.xxhash64("k"), F.lit(16)).alias("p")).collect()}
            after = files(tmp_path / "t")
            untouched = {f: t for f, t in before.items() if int(f.split("part=")[1].split("/")[0]) not in parts}
            assert untouched and all(after.get(f) == t for f, t in untouched.items())


def test_a_batch_run_again_changes_nothing(spark, table):
    rng = random.Random(5)
    batches = [batch(rng, range(20), 100), batch(rng, range(30), 60)]
    for number, rows in enumerate(batches):
        table.merge(spark.createDataFrame(rows, SCHEMA), number)
    once = held(table)
    table.merge(spark.createDataFrame(batches[1], SCHEMA), 1)
    assert held(table) == once == expected(batches)


def test_empty_batches(spark, table):
    table.merge(spark.createDataFrame([(1, 2, "a", 1, 4)], SCHEMA), 0)
    table.merge(spark.createDataFrame([], SCHEMA), 1)
    assert held(table) == {1: (2, "a", 1, 4)}
