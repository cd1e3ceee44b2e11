"""The dealt queries against their SQL at the smallest scale."""

import duckdb
import pytest

from strideframe.llm import catalog
from strideframe.session import TABLES


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    answer = duck.sql(catalog.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert found == sorted(repr(tuple(r[i] for i in at)) for r in answer.fetchall())
