"""Runs named queries beside their SQL on DuckDB and reports what differs: python tests/compare.py DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):  # noqa: ANN001, ANN201
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(canon(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def rows(pdf):  # noqa: ANN001, ANN201
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None) if not pdf.empty else pdf
    return sorted((tuple(canon(x) for x in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def compare(spark, con, name, query, sql, sf_dir):  # noqa: ANN001, ANN201
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"rows {len(a)} {len(b)}; only Spark {sorted(sa - sb)[:3]}; only SQL {sorted(sb - sa)[:3]}"


def connect(sf_dir):  # noqa: ANN001, ANN201
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e

    from panelwright.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="10g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    d, names = sys.argv[1], sys.argv[2:]
    qs, sql, con, bad = e.queries(), e.oracle_sql(), connect(sys.argv[1]), 0
    for n in names or sorted(sql):
        t = time.time()
        try:
            why = compare(spark, con, n, qs[n], sql[n], d) if n in sql else f"no SQL; {qs[n](spark, d).count()} rows"
        except Exception as x:  # noqa: BLE001
            why = f"error {type(x).__name__}: {str(x)[:600]}"
        bad += bool(why) and not why.startswith("no SQL")
        print(f"{'ok  ' if not why else 'DIFF'} {n} {time.time() - t:.1f}s {why}", flush=True)
    print("differences:", bad)
