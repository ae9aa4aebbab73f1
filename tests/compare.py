"""Compare queries with their SQL twins in DuckDB: python tests/compare.py SF_DIR NAME..."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def compare(spark, sf: str, name: str, fn, sql: str | None):
    """(equal, text)."""
    t = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"{name}: {len(got)} rows, {took:.1f} s, no SQL"
    cur = duck(sf).execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} and {sorted(cols)}"
    if got == want:
        return True, f"{name}: {len(got)} rows equal, {took:.1f} s"
    a, b = set(map(repr, got)), set(map(repr, want))
    return False, f"{name}: {len(got)} and {len(want)} rows; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from stemma.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or qs:
        try:
            print(*compare(spark, sys.argv[1], n, qs[n], sqls.get(n)), flush=True)
        except Exception as x:  # noqa: BLE001
            print(False, n, repr(x)[:1500], flush=True)
