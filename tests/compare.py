"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"max_temp_directory_size": "4GB", "memory_limit": "12GB"})
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs first."""
    df = query(spark, sf_dir)
    got, names = _rows(df.collect(), df.columns), df.columns
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = _rows(res.fetchall(), want_names)
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; {[r for r in got if r not in set(want)][:2]} | {[r for r in want if r not in set(got)][:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{sorted(names)}: {g!r:.600} != {w!r:.600}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from marginalia.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        t = time.time()
        try:
            if name in entry.oracle_sql():
                result = difference(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql()[name]) or "ok"
            else:
                result = f"rows only: {len(entry.queries()[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:18s} {time.time() - t:6.1f}s {result}", flush=True)
