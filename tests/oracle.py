"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return repr(value + 0.0)  # 0.0 and -0.0 are the same value
    return None if value is None else repr(value)


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_cell(x) for x in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=lambda r: tuple((c is None, c or "") for c in r))


def _type(t) -> str:
    return str(t).replace("large_", "")


def differences(got, want, limit: int = 3) -> list[str]:
    """What differs between two Arrow tables: names, types, row count, values."""
    out = []
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    for name in got.column_names:
        a, b = _type(got.schema.field(name).type), _type(want.schema.field(name).type)
        if a != b:
            out.append(f"type of {name}: {a} != {b}")
    if got.num_rows != want.num_rows:
        out.append(f"rows {got.num_rows} != {want.num_rows}")
    a, b = _rows(got), _rows(want)
    wrong = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
    if wrong:
        out.append(f"{len(wrong)} rows differ, such as {wrong[:limit]}")
    return out
