"""Run a registered query and its SQL and compare the rows as unordered collections."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def differences(df, sf_dir: str, sql: str) -> list[str]:
    """Empty when columns, row count and all values agree."""
    names, expected = oracle_rows(sf_dir, sql)
    columns = sorted(df.columns)
    if columns != sorted(names):
        return [f"columns {columns} != {sorted(names)}"]
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_value(r[i]) for i in order) for r in expected)
    ours = Counter(tuple(_value(r[c]) for c in columns) for r in df.collect())
    if ours == theirs:
        return []
    only_ours, only_theirs = ours - theirs, theirs - ours
    return [
        f"rows {sum(ours.values())} vs {sum(theirs.values())}",
        *[f"only job: {dict(zip(columns, r))}" for r in list(only_ours)[:2]],
        *[f"only sql: {dict(zip(columns, r))}" for r in list(only_theirs)[:2]],
    ]
