"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from codexflow.plans import relational

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, float):
        return f"{value + 0.0:.4f}"
    return f"{float(value):.4f}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_query_equals_sql(spark, duck, name):
    got = relational.QUERIES[name](spark, DIR)
    relation = duck.sql(relational.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    mine = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    theirs = sorted(tuple(map(plain, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == theirs


def test_entry_points():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
