"""Every catalogue query against its SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from strideframe.plans import catalog
from strideframe.session import TABLES

SLOW: set[str] = set()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}") + 0.0
    return value


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in SLOW])
def test_matches_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())
    answer = duck.sql(catalog.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert found == sorted(repr(tuple(normal(r[i]) for i in at)) for r in answer.fetchall())


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
