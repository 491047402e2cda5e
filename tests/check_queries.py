"""Compare registered queries with their SQL: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v).__name__ if isinstance(v, str) else "n"), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result; empty when equal."""
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return [f"columns: {names} != {sorted(cols)}"]
    order = [cols.index(c) for c in names]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return [f"rows: {len(got)} != {len(want)}"]
    if not got:
        return ["no rows"]
    out = []
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        for name, x, y in zip(names, a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=0, abs_tol=0))
            if not same or (isinstance(x, float) != isinstance(y, float) and x is not None):
                out.append(f"{name}: {x!r} != {y!r}")
    return out


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_spark

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark, con = make_spark(), connect(sf_dir)
    bad = 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            diffs = compare(fn(spark, sf_dir), con, sql[name]) if name in sql else ["no SQL"]
        except Exception as e:  # noqa: BLE001
            diffs = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(diffs)
        print(f"{'BAD ' if diffs else 'ok  '} {name} {time.time() - start:.1f}s {len(diffs) or ''} {diffs[:4] if diffs else ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
