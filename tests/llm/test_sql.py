"""The registered queries that have SQL, against DuckDB."""

import os

import duckdb
import pytest

from labelloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        duck.execute(f"create view {name_} as select * from '{SF}/{name_}.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    wanted = sorted(map(repr, want.df()[columns].astype(object).itertuples(index=False, name=None)))
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got.toPandas()[columns].astype(object).itertuples(index=False, name=None))) == wanted
