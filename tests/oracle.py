"""Side by side with DuckDB: the same tables, columns by name, rows in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def _key(row):
    return tuple((x is None, str(x) if not isinstance(x, float) else f"{x:.9g}") for x in row)


def same(df, sf_dir: str, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    cols, rows = duck(sf_dir, sql)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    order = sorted(cols)
    mine = sorted(([r[c] for c in order] for r in df.collect()), key=_key)
    theirs = sorted(([r[cols.index(c)] for c in order] for r in rows), key=_key)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs, strict=True):
        for c, x, y in zip(order, a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float) and x != y and not math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12):
                return f"{c}: {a} and {b}"
            if not isinstance(x, float) and str(x) != str(y) and not (type(x) is not type(y) and float(x) == float(y)):
                return f"{c}: {a} and {b}"
    return ""
