"""Compare a query with its SQL the way the driver does: columns by name, rows as a multiset."""

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, name, query, sql, d):
    df = query(spark, d)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        t = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols, (name, names, cols)
    order = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in order) for r in res.fetchall())
    assert got == want, (name, sum(got.values()), sum(want.values()), list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
