"""Compare the registered queries with their SQL on DuckDB.

Run: python -m checks.compare [sf_dir] [name …]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows under the same column names, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    expected = sorted(
        (tuple(row[names.index(n)] for n in order) for row in result.fetchall()), key=_key
    )
    got = sorted((tuple(row[n] for n in order) for row in df.collect()), key=_key)
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for a, b in zip(got, expected):
        for n, x, y in zip(order, a, b):
            same = x == y and type(x) is type(y) or (
                isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-9)
            )
            if not same:
                return f"{n}: {x!r} against {y!r} in {a} / {b}"
    return None


def main() -> int:
    from aislekit.session import build_session
    from checks.all import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="aislekit-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                fault = difference(df, con, ORACLES[name])
                rows = ""
            else:
                rows, fault = f"{df.count()} rows, no SQL", None
        except Exception as e:  # a check that breaks is a difference too
            fault, rows = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += fault is not None
        print(f"{'ok  ' if fault is None else 'BAD '} {name} {time.time() - start:.1f}s {rows} {(fault or '')[:1500]}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
