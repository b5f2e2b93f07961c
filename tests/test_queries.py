"""Every coding query against its SQL on a small table."""

import os

import pytest

from stratacode.plans.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    want = sql.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
