import importlib.util

import pytest

import __spark_entry__ as e

duckdb = pytest.importorskip("duckdb")


def test_registry():
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert {f"p{n}_found" for n in (1, 4, 7)} <= set(q)
    if importlib.util.find_spec("clausewright.llm"):
        assert {f"p{n}_found" for n in (2, 3, 5, 6, 10)} <= set(q)


def test_entry(spark):
    assert e.entry(spark).columns == ["table_name", "row_id", "field_name", "node_path"]
