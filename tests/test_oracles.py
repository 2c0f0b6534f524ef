"""Every query with oracle SQL against DuckDB, on the smallest tables."""

import importlib.util
import os

import pytest

from quarry import oracles, queries

spec = importlib.util.spec_from_file_location("compare", os.path.join(os.path.dirname(__file__), "..", "tools", "compare.py"))
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equal(spark, sf, name):
    assert compare.compare(spark, sf, [name]) == {name: None}


def test_every_query_runs_without_an_oracle_too(spark, sf):
    for name, f in queries.queries().items():
        if name not in oracles.ORACLES:
            assert f(spark, sf).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
