"""Order-insensitive comparison of a Spark result with the result of SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows(table, names: list[str]) -> list[tuple]:
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=lambda t: tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "", round(v, 5)) for v in t))


def difference(left, right) -> str | None:
    """First difference between two Arrow tables, or None if they hold the same rows."""
    names = sorted(left.column_names)
    if names != sorted(right.column_names):
        return f"columns {names} != {sorted(right.column_names)}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} != {right.num_rows}"
    for a, b in zip(rows(left, names), rows(right, names), strict=True):
        for n, p, q in zip(names, a, b, strict=True):
            if p == q:
                continue
            numbers = isinstance(p, (int, float)) and isinstance(q, (int, float))
            if not (numbers and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6)):
                return f"{n}: {p!r} != {q!r} in {dict(zip(names, a, strict=True))} / {dict(zip(names, b, strict=True))}"
    return None
