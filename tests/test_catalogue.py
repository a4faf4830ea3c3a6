"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(list(v)) if isinstance(v, list | tuple) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLES:
        want = con.execute(catalogue.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(names)
        assert got == rows(names, want.fetchall())
