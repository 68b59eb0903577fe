"""Compare registered queries with their SQL in DuckDB. Run: python tests/oracle.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((kind(r[i]), plain(r[i])) for i in order) for r in rows)


def compare(spark, con, folder, query, sql) -> str | None:
    t0 = time.time()
    df = query(spark, folder)
    mine = df.collect()
    compare.spark_seconds = time.time() - t0
    got = rows_of(df.columns, mine)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        return (f"rows {sum(got.values())} vs {sum(want.values())}; only spark {list((got - want).items())[:2]}; "
                f"only sql {list((want - got).items())[:2]}")[:1500]
    return None


def main(folder, names):
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import session
    spark, con = session(), connect(folder)
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                err = compare(spark, con, folder, fn, sqls[name])
                note = f"same (spark {compare.spark_seconds:.1f}s)" if err is None else err
            else:
                n = fn(spark, folder).count()
                err, note = (None if n else "no rows"), f"{n} rows (no sql)"
        except Exception as e:  # noqa: BLE001
            err = note = f"{type(e).__name__}: {e}"[:1500]
        if err:
            bad.append(name)
        print(f"{'FAIL' if err else 'ok  '} {name} {time.time() - t0:.1f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    main(folder, set(args[1:]))
