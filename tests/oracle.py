"""Run a query and its SQL over the same tables and compare sorted rows."""

from __future__ import annotations

import datetime
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, datetime.datetime):
        return x.date().isoformat() if x.time() == datetime.time() else x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def difference(spark, con, sf_dir: str, function, sql: str) -> str | None:
    frame = function(spark, sf_dir)
    got_columns = frame.columns
    got = [tuple(r) for r in frame.collect()]
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    wanted = result.fetchall()
    if sorted(columns) != sorted(got_columns):
        return f"columns {sorted(got_columns)} and {sorted(columns)}"
    order = [got_columns.index(c) for c in columns]
    a = sorted((tuple(_plain(r[i]) for i in order) for r in got), key=repr)
    b = sorted((tuple(_plain(x) for x in r) for r in wanted), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
