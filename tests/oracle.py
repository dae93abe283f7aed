"""Rows of a query and of its SQL in one comparable form."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, isinstance(x, str), x if x is not None else 0) for x in r))


def both(spark, sf_dir, query, sql):
    """(columns, rows) of the query and of the SQL, columns by name."""
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = ordered(tuple(plain(x) for x in r) for r in frame.select(*names).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    theirs = [d[0] for d in found.description]
    at = [theirs.index(n) if n in theirs else -1 for n in names]
    rows = ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    return (names, ours), (sorted(theirs), rows)
