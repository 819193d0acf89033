"""Compare registered queries with their SQL: python -m tests.oracle [folder] [name...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

import __spark_entry__ as driver
from gleaner.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = driver.queries()[name](spark, folder)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    cols, rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    cur = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for c, ty in types.items():
        if ty in same and duck_types[c] != same[ty]:
            return f"type of {c}: {ty} != {duck_types[c]}"
    if not want:
        return "the SQL gives no rows"
    if rows != want:
        diff = next(((a, b) for a, b in zip(rows, want) if a != b), (len(rows), len(want)))
        return f"{len(rows)} rows, SQL {len(want)}; first difference\n  spark {diff[0]}\n  sql   {diff[1]}"
    return None


def main(argv: list[str]) -> int:
    folder = next((a for a in argv if "/" in a), "/root/testdata/sf0.01")
    names = [a for a in argv if "/" not in a] or list(driver.queries())
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = check(spark, con, name, folder)
        except Exception:
            found = "".join(traceback.format_exc()[-1800:])
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok; at {Path(folder).name}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
