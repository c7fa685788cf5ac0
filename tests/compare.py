"""Run registered queries in Spark and their SQL in DuckDB and compare values, ignoring row order."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf: str):
    from tidemark.catalog.core import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(v + 0.0 if v else 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v if isinstance(v, str) else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(_norm(r[k]) for k in order) for r in rows), key=repr)


def compare(name: str, df, con, sql: str) -> str | None:
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    want = rows_of(cols, cur.fetchall())
    if len(got) != len(want):
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; only spark {str(a)[:300]}; only sql {str(b)[:300]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {str(bad[0])[:700]}" if bad else None


if __name__ == "__main__":
    from tidemark.catalog import load
    from tidemark.catalog.core import RUN, SQL, Inputs
    from tidemark.session import get_session
    load()
    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for n in RUN:
        if only and not any(o in n for o in only):
            continue
        t0 = time.time()
        try:
            df = RUN[n](Inputs(spark, sf))
            msg = compare(n, df, con, SQL[n]) if n in SQL else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e)[:900]
        print(f"{n:28s} {time.time() - t0:6.2f}s {msg or 'ok'}", flush=True)
