"""Text operators with SQL give what DuckDB gives, at the smallest size."""

import duckdb
import pytest
from codequarry.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got and got == sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, name)
