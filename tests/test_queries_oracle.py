"""Every registered query runs on the smallest driver tables and matches its
DuckDB twin (row count, column names, order-insensitive values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from thinkframe.sources.tables import TABLES

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(E.QUERIES) == set(E.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, s_rows) == _rows(d_cols, res.fetchall())


def test_entry_smoke(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) > 0 and set(out.columns) == {"lang", "num_questions", "num_correct", "num_unanswered", "accuracy"}


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", ["final_table", "repeat_stats", "think_mask", "summary_records"])
def test_query_types_match_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        assert SPARK_TO_DUCK.get(f.dataType.simpleString()) == duck[f.name], f.name


@pytest.mark.parametrize("tz", ["America/Los_Angeles", "Asia/Kolkata"])
def test_timestamp_queries_independent_of_session_zone(spark, tz):
    names = ["train_comparison", "memory_peak"]
    base = {n: sorted(map(tuple, E.queries()[n](spark, SF_SMALL).collect()), key=repr) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", tz)
    try:
        for n in names:
            assert sorted(map(tuple, E.queries()[n](spark, SF_SMALL).collect()), key=repr) == base[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
