"""Every registered query against its SQL on the test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    assert rows, "a query over the test tables returns rows"
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
