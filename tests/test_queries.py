"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from basaltine.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return "None" if x != x else repr(round(float(x), 7))
    return "None" if str(x) in ("NaT", "<NA>") else str(x)


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in at) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    mine = rows(got.columns, got.collect())
    if name in catalog.ORACLE:
        want = con.sql(catalog.ORACLE[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert mine == rows(want.columns, want.fetchall())
