"""Every query with a DuckDB statement must give the same rows as DuckDB."""
import pytest

from compare import compare, connect
from corpuscope.queries import QUERIES
from oracle import SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_duckdb(spark, con, name):
    problem, _ = compare(spark, con, QUERIES[name], SQL[name], FOLDER)
    assert problem is None


def test_every_statement_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(SQL)) == ["render_report", "repair_loop"]
