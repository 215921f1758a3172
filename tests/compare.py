"""Strict comparison of a registered query with its SQL statement."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else v)
    return repr(v)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types, row count and all values agree exactly."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if KINDS.get(kind) != types[field.name]:
            out.append(f"type {field.name}: {kind} vs {types[field.name]}")
    expected = [dict(zip(names, row)) for row in rel.fetchall()]
    got = [row.asDict() for row in df.collect()]
    if len(expected) != len(got):
        out.append(f"rows {len(got)} vs {len(expected)}")
    cols = sorted(names)
    a = sorted(tuple(_norm(row[c]) for c in cols) for row in got)
    b = sorted(tuple(_norm(row[c]) for c in cols) for row in expected)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        out.append(f"values\n   spark {only_a}\n   sql   {only_b}\n   of {cols}")
    return out
