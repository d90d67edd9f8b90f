"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from orbweave.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return (0, 0)
    return (1, float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else (2, str(value))


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found, expected = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    pick = lambda row, names: tuple(plain(row[names.index(c)]) for c in columns)
    rows = sorted(pick(tuple(r), found.columns) for r in found.collect())
    assert rows == sorted(pick(r, expected.columns) for r in expected.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1473
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
