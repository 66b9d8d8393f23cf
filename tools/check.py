"""Run registered queries against their SQL twins on DuckDB and report differences.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from chronoseal.plans import load_all  # noqa: E402
from chronoseal.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"f{value!r}"
    return f"{type(value).__name__[0]}{value}"


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    registry = load_all()
    spark = local_session(8)
    con = duck(sf_dir)
    bad = 0
    for name, query in registry.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = query.run(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if query.sql is None:
            print(f"ROWS  {name} {len(rows)} rows {took:.1f}s {df.columns}", flush=True)
            continue
        try:
            res = con.execute(query.sql)
            columns = [d[0] for d in res.description]
            expected = res.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(error)[:1200]}", flush=True)
            continue
        got, want = normal(df.columns, rows), normal(columns, expected)
        if sorted(df.columns) != sorted(columns):
            bad += 1
            print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(columns)}", flush=True)
        elif got != want:
            bad += 1
            diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows; {sorted(columns)}; {diff}", flush=True)
        else:
            print(f"OK    {name} {len(rows)} rows {took:.1f}s", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
