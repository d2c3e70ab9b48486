"""Every query with SQL gives the rows of that SQL, at the smallest scale."""

import os

import duckdb
import pytest

from postsieve.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("NULL" if r[i] is None else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, got.fetchall())
