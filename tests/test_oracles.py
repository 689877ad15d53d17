"""Every query with an oracle gives the rows that DuckDB gives for it; the values of the others are tested in test_values."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(str(plain(row[k])) for k in order) for row in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF)
    result = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(result.columns)
    assert rows(found.columns, found.collect()) == rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_a_test_of_its_values(name):
    with open(os.path.join(os.path.dirname(__file__), "test_values.py"), encoding="utf-8") as file:
        assert f'"{name}"' in file.read()


def test_names_are_the_same():
    assert set(ORACLES) <= set(QUERIES) and registry.FLAGSHIP in QUERIES
