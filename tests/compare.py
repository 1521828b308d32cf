"""Run bound queries beside their SQL and compare rows, columns and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "isoformat"):
        return str(value).split("+")[0]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; e.g. {got[:1]} vs {want[:1]}"
    for a, b in zip(got, want):
        if a != b:
            return f"values {[(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]}"
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from furrow.bindings import ORACLES, QUERIES
    from furrow.session import build_session
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    names = [n for pattern in names for n in QUERIES if n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            note = difference(frame, con, ORACLES[name]) if name in ORACLES else f"rows only: {frame.count()}"
        except Exception as failure:
            note = f"{type(failure).__name__}: {str(failure)[:1500]}"
        ok = note is None or note.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {note or ''}", flush=True)
    print(f"{len(names)} run, {bad} failed")
