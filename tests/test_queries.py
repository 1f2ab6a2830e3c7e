"""Every registered query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from loomlog.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not there")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, SF).toArrow(), sql.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(tuple(map(str, r)) for r in zip(*[t.column(c).to_pylist() for c in columns]))
    assert rows(got) == rows(want)
    assert [str(got.schema.field(c).type) for c in columns] == [str(want.schema.field(c).type) for c in columns]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
