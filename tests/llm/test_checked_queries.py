"""Queries with SQL run on both engines over whole tables."""

from types import SimpleNamespace

import pytest
from oracle import compare

from pleonasm.llm.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, folder, name):
    item = SimpleNamespace(build=QUERIES[name], sql=ORACLE[name])
    problem = compare(spark, duck, folder, item)
    assert problem is None, problem


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
