"""Run a registered query and its SQL on the same tables and compare the rows.

Also a command: ``python -m tests.compare <sf_dir> [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat() + "T00:00:00"
    return v


def _bag(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in at) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None where the rows agree, else a short text saying how they differ."""
    df = query(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got, want = _bag(df.columns, got_rows), _bag(names, rows)
    if got == want:
        return None
    extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"{len(got_rows)} rows against {len(rows)}; only here {extra}; only there {missing}"


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from tideline.session import local_session

    spark = local_session("compare")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        if name not in sql:
            n = query(spark, sf_dir).count()
            print(f"rows {name} {n} {time.time() - start:.1f}s", flush=True)
            continue
        try:
            diff = difference(spark, con, query, sql[name], sf_dir)
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
