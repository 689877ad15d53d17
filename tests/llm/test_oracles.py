"""The operators' queries against their SQL."""

import duckdb
import pytest

from tests.test_oracles import TABLES, rows
from tidemark.llm import queries

QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.01" if name.startswith("op5") else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    found, result = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(result.columns)
    assert rows(found.columns, found.collect()) == rows(result.columns, result.fetchall())
