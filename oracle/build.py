"""Helpers that put a statement together from named common table expressions."""
from __future__ import annotations

import re

CTES: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def inlist(col, items) -> str:
    return f"{col} IN (" + ", ".join(lit(i) for i in items) + ")" if items else "false"


def anyword(col, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def rx(col, regex) -> str:
    return f"regexp_matches({col}, {lit(regex)})"


def hasdir(names, lower=False) -> str:
    path = "lower(path)" if lower else "path"
    return f"list_has_any(list_slice(string_split({path}, '/'), 1, len(string_split({path}, '/')) - 1), [{', '.join(lit(n) for n in names)}])"


def title(expr) -> str:
    return f"coalesce(array_to_string(list_transform(regexp_extract_all(lower({expr}), '[a-zà-öø-ÿ]+|[^a-zà-öø-ÿ]'), lambda w: upper(w[1:1]) || w[2:]), ''), '')"


def display(expr) -> str:
    return title(f"replace({expr}, '_', ' ')")


def snake(expr) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', '_', 'g'), '_')"


def stripped(expr) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def base(path="path") -> str:
    return f"string_split({path}, '/')[-1]"


def stem(path="path") -> str:
    return rf"regexp_replace({base(path)}, '^(.+)\.[^.]+$', '\1')"


def ext(path="path") -> str:
    return rf"lower(regexp_extract({base(path)}, '^.+(\.[^.]+)$', 1))"


def topdir(path="path") -> str:
    return f"CASE WHEN contains({path}, '/') THEN string_split({path}, '/')[1] ELSE 'root' END"


def case(pairs, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def num(prefix, n, width) -> str:
    return f"{lit(prefix)} || CASE WHEN length(CAST({n} AS VARCHAR)) < {width} THEN lpad(CAST({n} AS VARCHAR), {width}, '0') ELSE CAST({n} AS VARCHAR) END"


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def q(name: str, sql: str) -> None:
    QUERIES[name] = sql


def _used(sql: str) -> set:
    return {n for n in CTES if re.search(rf"\b{n}\b", sql)}


def statement(body: str) -> str:
    need, todo = set(), _used(body)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo |= _used(CTES[name]) - need
    parts = [f"{n} AS (\n{CTES[n]}\n)" if not CTES[n].startswith("RECURSIVE") else CTES[n][10:] for n in CTES if n in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
