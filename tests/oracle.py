"""Runs a query and its SQL on the same tables and compares their rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(round(v, 6) + 0.0, ".6f")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([_plain(r[k]) for k in order]) for r in rows)


def compare(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = rows_of(names, found.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(expected), f"{len(got)} rows, SQL has {len(expected)}"
    different = [(g, e) for g, e in zip(got, expected, strict=True) if g != e]
    assert not different, f"{len(different)} rows differ, first: {different[0]}"
