"""Compares a query with its SQL in DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return norm(value.asDict())
    if hasattr(value, "tzinfo") and hasattr(value, "replace"):
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return norm(float(value)) if value != int(value) else int(value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """What is different; empty if nothing is."""
    df = query(spark, sf_dir)
    a, b = table(df.columns, df.collect()), table(*oracle(sql, sf_dir))
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; first {a[1][:2]} and {b[1][:2]}"
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(wrong)} rows differ: {wrong[:3]}" if wrong else ""
