"""Queries with a DuckDB statement give the same rows as DuckDB; every operator is registered."""
import re

import pytest
from compare import compare, connect

from corpuscope.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    folder = "/root/testdata/sf0.001"
    problem, n = compare(spark, connect(folder), QUERIES[name], SQL[name], folder)
    assert problem is None and n


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
