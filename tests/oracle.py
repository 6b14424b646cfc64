"""Runs a query and its SQL over the same tables and compares their rows."""

import decimal
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(v.item()) if hasattr(v, "item") else v


def same(spark, sf_dir, query, sql):
    import duckdb

    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(x) for x in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    theirs = db.sql(sql)
    assert sorted(theirs.columns) == columns
    order = [theirs.columns.index(c) for c in columns]
    rows = Counter(repr(tuple(plain(r[i]) for i in order)) for r in theirs.fetchall())
    assert ours == rows, (list((ours - rows))[:3], list((rows - ours))[:3])
