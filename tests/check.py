"""Compare every registered query with its SQL in DuckDB. Usage: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine), "rows only" if mine else "EMPTY"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(mine), f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    if mine != theirs:
        diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:1]
        return len(mine), f"DIFF rows {len(mine)} vs {len(theirs)} {repr(diff)[:900]}"
    return len(mine), "ok" if mine else "EMPTY"


def main():
    from quire.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            n, verdict = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            n, verdict = -1, f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:7d} {time.time() - t:6.2f}s {verdict}", flush=True)
    print("bad:", bad, "of", len(queries), "oracles:", len(oracles))


if __name__ == "__main__":
    main()
