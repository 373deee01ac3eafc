"""The registered queries against their SQL, on the smallest tables; and that all of them run."""

import math

import duckdb
import pytest
from probitas.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 7) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, sf, duck, name):
    df = Q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in Q.oracle_sql():
        assert got
        return
    cur = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(normal(row[i]) for i in order) for row in cur.fetchall()]
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(got, key=key) == sorted(want, key=key)
