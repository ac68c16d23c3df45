"""DuckDB statements that compute the registered queries independently."""
from . import tables, results  # noqa: F401
from .build import QUERIES, statement

SQL = {name: statement(body) for name, body in QUERIES.items()}
