"""The operators' queries against their SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from chronofold.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in mine.collect()) == sorted(str([r[i] for i in at]) for r in theirs.fetchall())


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
