"""Queries with a DuckDB twin give its rows on the smallest driver tables."""

import duckdb
import pytest

from thinkframe.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    got = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(got.fetchall())
