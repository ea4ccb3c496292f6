"""Every bound query against its SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from auditloom.plans.bound import registered
from tools.check_oracle import TABLES, rows_of

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registered()[0]))
def test_query_equals_its_sql(spark, db, name):
    frame = queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in frame.collect()]
    result = db.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, got) == rows_of(columns, result.fetchall())


def test_every_query_has_an_oracle():
    bound, sql = registered()
    assert set(bound) == set(sql)
    assert set(bound) <= set(queries()) and set(sql) <= set(oracle_sql())


def test_entry_has_one_row_per_source(spark):
    assert entry(spark).columns == ["repo", "score"]
    assert entry(spark).count() > 0
