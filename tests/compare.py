"""Spark result against DuckDB result on the same parquet tables.

`python -m tests.compare [key ...]` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
from decimal import Decimal

import duckdb

DEFAULT = "/root/testdata/sf0.01"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if hasattr(value, "tzinfo") and value is not None and getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def kinds(names, rows):
    """Python type of the first non-null value of every column."""
    found = {}
    for i, n in enumerate(names):
        found[n] = next((type(plain(r[i])).__name__ for r in rows if r[i] is not None), None)
    return found


def compare(spark, fn, sql, folder=DEFAULT, con=None):
    """None when equal, otherwise a text saying what differs."""
    con = con or connect(folder)
    df = fn(spark, folder)
    got_raw = df.collect()
    rel = con.execute(sql)
    want_names = [d[0] for d in rel.description]
    want_raw = rel.fetchall()
    a_names, a = rows_of(df.columns, got_raw)
    b_names, b = rows_of(want_names, want_raw)
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} / {b[:1]}"
    ka, kb = kinds(df.columns, got_raw), kinds(want_names, want_raw)
    if ka != kb:
        return f"types {({k: (ka[k], kb[k]) for k in ka if ka[k] != kb[k]})}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ {a_names}; first {bad[0]}"
    return None


def main(keys):
    import __spark_entry__ as entry
    from tallyforge.session import build_session, release

    spark = build_session("local[8]", "compare", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tallyforge-shared-"))
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("SF_DIR", DEFAULT)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in queries:
        if keys and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in keys):
            continue
        start = time.time()
        try:
            if key in oracles:
                problem = compare(spark, queries[key], oracles[key], folder, con)
                note = "ok"
            else:
                problem, note = None, f"rows {len(queries[key](spark, folder).collect())}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        release(spark)
        failed += problem is not None
        print(f"{key:28s} {time.time() - start:6.2f}s  {problem[:1800] if problem else note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
