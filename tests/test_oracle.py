"""Every registered query with a check runs on both engines; the others must return rows."""

import pytest
from oracle import compare

from pleonasm.catalog import load

# The composed jobs have their own tests.
NAMES = [name for name, item in load().items() if item.module != "whole"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, folder, name):
    problem = compare(spark, duck, folder, load()[name])
    assert problem is None, problem
