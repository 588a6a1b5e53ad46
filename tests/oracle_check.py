"""Runs registered queries next to their DuckDB twins and compares sorted values.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, fn, sql) -> tuple[bool, str]:
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    described = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    types = [(c, t, described[c]) for c, t in df.dtypes if c in described and kinds.get(t) != described[c]]
    cur = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != exp_cols:
        return False, f"columns {got_cols} != {exp_cols}"
    if len(got) != len(exp):
        return False, f"rows {len(got)} != {len(exp)}"
    bad = [(a, b) for a, b in zip(got, exp) if repr(a) != repr(b)]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(got_cols, *bad[0]) if repr(x) != repr(y)]
        return False, f"{len(bad)}/{len(got)} rows differ, first: {diff}"
    return True, f"{len(got)} rows" + (f" TYPES {types}" if types else "")


def main(argv):
    from kickline.queries import ORACLE, QUERIES
    from kickline.session import build_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark, con = build_session("local[8]"), connect(sf)
    if os.environ.get("ROWS_PER_BLOCK"):   # force the hot-key path
        spark.conf.set("spark.kickline.rowsPerBlock", os.environ["ROWS_PER_BLOCK"])
    failed = []
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf, name, fn, ORACLE.get(name))
        except Exception as exc:  # report and go on with the next query
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print(f"failed: {len(failed)} {failed}")


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv[1:])
