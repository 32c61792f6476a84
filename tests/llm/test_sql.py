"""The queries that SQL can express, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op3_minhash", "op8_line_dedup", "op9_url_filters", "op11_fill_in_middle", "op12_top_k", "op13_divergence"])
def test_query_like_its_sql(spark, name):
    queries = pytest.importorskip("basaltine.llm.queries")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
