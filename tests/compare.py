"""Run a registered query and its check SQL on the same tables and compare."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(_cell(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(repr(v)) + 0.0
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, folder, limit: int = 3) -> list[str]:
    """What differs between the two results; empty when they agree."""
    df = query(spark, folder)
    got_rows = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want_rows = result.fetchall()
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if t in kinds and types[c] != kinds[t]:
            found.append(f"type of {c}: {t} against {types[c]}")
    got, want = _rows(df.columns, got_rows), _rows(names, want_rows)
    if len(got) != len(want):
        found.append(f"{len(got)} rows against {len(want)}")
    if got != want:
        only_got = [r for r in got if r not in set(want)][:limit]
        only_want = [r for r in want if r not in set(got)][:limit]
        found.append(f"columns {sorted(df.columns)}; only here {only_got}; only in the check {only_want}")
    return found
