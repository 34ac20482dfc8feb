"""Every registered query against its SQL in DuckDB, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_is_its_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
