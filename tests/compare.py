"""Compare a registered query with its SQL twin, and with itself under other settings."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def mismatch(df, con, sql):
    """None when equal, else a short description."""
    columns, rows = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} / {sorted(names)}"
    a, b = canonical(columns, rows), canonical(names, other)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}; e.g. {[x for x in a if x not in b][:2]} / {[x for x in b if x not in a][:2]}"
    for x, y in zip(a, b):
        if x != y and not _close(x, y):
            return f"row {x} / {y}"
    return None


def _close(x, y):
    return all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-8, abs_tol=1e-9)) for p, q in zip(x, y))
