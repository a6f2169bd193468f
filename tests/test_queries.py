"""Every query with SQL gives what DuckDB gives, at the smallest size; the rest of the contract with the driver."""

import __spark_entry__
import duckdb
import pytest
from codequarry.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = query(spark, SF), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(dict(zip(want.columns, r))[c]) for c in order) for r in want.fetchall()), key=repr)



@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_as_sql(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLES[name])


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["method_name", "file", "complexity", "coverage", "score"] and df.count() > 0


def test_every_query_of_this_part_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES) <= set(__spark_entry__.queries())
