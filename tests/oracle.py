"""Compares registered queries with their SQL twins in DuckDB.

Run as a script: python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "tz_localize") or hasattr(v, "isoformat"):
        return str(v)[:19].replace(" 00:00:00", "")
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(f) else f


def _key(row):
    return tuple((v is None, isinstance(v, str), v if isinstance(v, str) else (0.0 if v is None else float(f"{v:.6g}"))) for v in row)


def _same(a, b):
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return a == b
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != cols:
        return f"columns differ: spark-only {set(cols) - set(names)}, sql-only {set(names) - set(cols)}"
    types = {d[0]: str(d[1]) for d in want.description}
    place = [names.index(c) for c in cols]
    rows_b = [tuple(_norm(r[i]) for i in place) for r in want.fetchall()]
    at = [df.columns.index(c) for c in cols]
    rows_a = [tuple(_norm(r[i]) for i in at) for r in df.collect()]
    if len(rows_a) != len(rows_b):
        return f"rows: spark {len(rows_a)} sql {len(rows_b)}"
    rows_a.sort(key=_key)
    rows_b.sort(key=_key)
    for x, y in zip(rows_a, rows_b):
        bad = [(c, p, r) for c, p, r in zip(cols, x, y) if not _same(p, r)]
        if bad:
            return f"values: {bad[:4]} in row {dict(list(zip(cols, x))[:4])}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT",
             "decimal(38,0)": "DECIMAL(38,0)", "decimal(38,2)": "DECIMAL(38,2)"}
    wrong = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    return f"types (values equal): {wrong[:5]}" if wrong else None


def main():
    from featherfold.catalog import ORACLE, QUERIES
    from featherfold.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            note = compare(df, con, ORACLE[name]) if name in ORACLE else f"no sql; rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            import traceback

            note = f"ERROR {type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = note is None or note.startswith("no sql")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
